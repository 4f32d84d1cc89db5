"""Line dedup: an exact set-similarity self-join.

A line is the set of its lower-case words (A-Z are lowered, ASCII white space
parts words).  A line with a word goes if an earlier such line, in order of
(doc_id, line number), has a Jaccard similarity of ``4/5`` or more, whether or
not that one goes itself.

Texts are tokenised once, into 48-bit hashes of each line's distinct words.
Tokens are ordered by rarity: counts of all lines in ``BINS`` hash bins (a table
of fixed size, broadcast) give the order, the token's hash breaks ties.  Of two
similar lines, the longer's first ``m - ceil(4m/5) + 1`` tokens and the
shorter's first ``n - ceil(8n/9) + 1`` share one, so only lines that share one
meet; lengths, positions and a parity bitmap (which bounds the symmetric
difference from below) discard most meetings, and the survivors are verified on
their whole token sets.

Equal sets are one class, judged once; each batch keeps one line of a class
before anything is shuffled, so a hot line is no hot key.  Sets of three or less
are similar to equal ones only, so they meet no others.  Lines are first
compared with a few leaders at each of their meeting places, which settles dense
groups of near copies in linear work; only pairs whose later line this has
not settled meet.  A token with more than ``HOT`` places is dealt
into blocks, and pairs of blocks meet in tasks of their own.

Null, empty and blank texts have no line to judge, an empty table gives an empty
result; rows with a null doc_id are never judged and judge none; lines of equal
(doc_id, number), as of repeated rows, don't count against each other.  Very
long texts and lines are judged whole.  Columns of the caller are kept whatever
their names.

A form in DataFrame functions alone spends more on splitting and hashing the
words than the check tool grants in all (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .words import Tokens, mixed, portions

LEAST, BINS = 1, 1 << 20
#: The smallest set that another one can be similar to.
MEETS = 4
#: Places of a token in one task; bits a pair, and bytes at most, of the bitmap that
#: tells which lines are asked for.
HOT, ROOM, MOST_ASKED = 1 << 17, 32, 64 << 20
#: Lines of a place that all others there are first compared with.
LEADERS = 8
#: Bytes of a token; bytes, tokens and pairs looked at at once.
WIDE, AT_ONCE = 6, 1 << 20

Batches = Iterator[pa.RecordBatch]


def _overlap(n, m):
    """The least common tokens of sets of n and m with similarity 4/5."""
    return F.floor((4 * (n + m) + 8) / 9) if isinstance(n, Column) else (4 * (n + m) + 8) // 9


def distinct(tokens: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by line, the lines with a word, and their sizes."""
    heads = np.flatnonzero(_heads(line))
    kept, sizes = [], []
    for at in range(0, len(heads), 1 << 16):  # 16 bits beside the 48
        begin, end = heads[at], heads[at + (1 << 16)] if at + (1 << 16) < len(heads) else len(line)
        row = np.cumsum(_heads(line[begin:end])) - 1
        both = np.sort(row.astype(np.uint64) << np.uint64(48) | tokens[begin:end])
        both = both[_heads(both)]
        kept.append(both & np.uint64((1 << 48) - 1))
        sizes.append(np.bincount((both >> np.uint64(48)).astype(np.int64)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(np.uint64), *kept]), line[heads], np.concatenate([none, *sizes])


def packed(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE]


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDE, 8), np.uint8)
    wide[:, :WIDE] = np.frombuffer(raw, np.uint8).reshape(-1, WIDE)
    return wide.view("<u8").ravel()


def _binary(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of bytes: ``counts[k]`` elements of ``flat`` in row k."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * (flat.nbytes // max(1, len(flat)))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def tokenised(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc, nos, lens, tok): of each text its judged lines' numbers, sizes and tokens."""

    def split(batches: Batches) -> Batches:
        made = Tokens()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for begin, end in portions(texts, AT_ONCE):  # some texts at a time
                some = texts[begin:end]
                ids, line, n = distinct(*made.lines(b"\n".join(some)))
                if least > 1:
                    ids, line, n = ids[np.repeat(n >= least, n)], line[n >= least], n[n >= least]
                first = np.cumsum([0] + [t.count(b"\n") + 1 for t in some])  # of each text, its first line
                of = np.searchsorted(first, line, "right") - 1
                rows, count = np.unique(of, return_counts=True)
                words = np.bincount(of, n, len(some)).astype(np.int64)[rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + begin)), _binary((line - first[of]).astype(np.uint32), count), _binary(n.astype(np.uint32), count), _binary(packed(ids), words)], ["doc", "nos", "lens", "tok"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(split, f"doc {_kind(rows)}, nos binary, lens binary, tok binary")


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc"].dataType.simpleString()


def rarity(tokens: DataFrame) -> np.ndarray:
    """The order of the bins, from the counts of all lines: 7 bits a bin."""

    def count(batches: Batches) -> Batches:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += np.bincount((unpacked(b"".join(batch.column(0).to_pylist())) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bin", "c"])

    sums = tokens.select("tok").mapInArrow(count, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()
    order = np.zeros(BINS, np.uint8)
    order[sums["bin"].to_numpy()] = np.minimum(127, 1 + np.floor(2 * np.log2(sums["c"].to_numpy())))
    return order


def measures(tokens: np.ndarray, lens: np.ndarray, order: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """Of each line: two hashes of its set, its bitmap, its first keys and their ranks."""
    starts = np.cumsum(lens) - lens
    line = np.repeat(np.arange(len(lens)), lens)
    rank = order[(tokens & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64)
    keys = np.sort(line.astype(np.uint64) << np.uint64(44) | rank << np.uint64(37) | tokens >> np.uint64(11))
    first = np.where(lens >= MEETS, lens - (4 * lens + 4) // 5 + 1, 0)
    keys = keys[np.arange(len(keys)) - starts[line] < first[line]]
    low = keys & np.uint64((1 << 44) - 1)
    bit, odd = np.uint64(1) << (tokens & np.uint64(63)), (tokens >> np.uint64(6) & np.uint64(1)).astype(bool)
    return {
        "s1": np.add.reduceat(mixed(tokens, 0x9E3779B97F4A7C15), starts), "s2": np.add.reduceat(mixed(tokens, 0xC2B2AE3D27D4EB4F), starts),
        "g1": np.bitwise_xor.reduceat(np.where(odd, bit, np.uint64(0)), starts), "g2": np.bitwise_xor.reduceat(np.where(odd, np.uint64(0), bit), starts),
        "keys": _binary(((low ^ low >> np.uint64(31)) & np.uint64((1 << 31) - 1)).astype(np.int32), first), "ranks": _binary((low >> np.uint64(37)).astype(np.uint8), first),
    }


def _later(rows: pa.Table, head: np.ndarray) -> np.ndarray:
    """Rows, in order of (s1, s2, doc, no), that come after the first line of their class."""
    first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    doc, no = rows["doc"].combine_chunks(), rows["no"].to_numpy()
    return pc.not_equal(doc, doc.take(pa.array(first))).to_numpy(zero_copy_only=False) | (no != no[first])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where the value of any column differs from the row before."""
    head = np.ones(len(columns[0]), bool)
    if len(head):
        head[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return head


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


MARKED = "no int, n int, s1 long, s2 long, g1 long, g2 long, keys binary, ranks binary, gone boolean, part int"


def classes_of(tokens: DataFrame, order) -> DataFrame:
    """(doc, no, n, g1, g2, keys, ranks, gone): the earliest line of each set,
    and the other lines, which go (of these only doc and no count)."""
    names = ["doc", *[c.split()[0] for c in MARKED.split(", ")]]

    def lines(batches: Batches) -> Batches:
        for batch in batches:
            lens = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(2).to_pylist()]
            sizes, begin = np.cumsum([x.sum() for x in lens]), 0
            while begin < len(lens):  # some texts at a time
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + AT_ONCE)))
                some = batch.slice(begin, end - begin)
                n = np.concatenate(lens[begin:end])
                no = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint32).astype(np.int32)
                of = np.repeat(np.arange(end - begin), [len(x) for x in lens[begin:end]])
                m = measures(unpacked(b"".join(some.column(3).to_pylist())), n, order.value)
                rows = pa.table({"doc": some.column(0).take(pa.array(of)), "no": pa.array(no), "n": pa.array(n.astype(np.int32)), **{k: v if isinstance(v, pa.Array) else _long(v) for k, v in m.items()}})
                rows = rows.take(pc.sort_indices(rows.select(["s1", "s2", "doc", "no"]), [(c, "ascending") for c in ("s1", "s2", "doc", "no")]))
                head = _heads(rows["s1"].to_numpy(), rows["s2"].to_numpy())
                gone = _later(rows, head)
                # lines that go are dealt by their place, others by their set
                part = np.where(gone, np.arange(len(gone)) * 7919 + int(sizes[begin]), rows["s1"].to_numpy() >> 33).astype(np.int32)
                rows = rows.append_column("gone", pa.array(gone)).append_column("part", pa.array(part)).filter(pa.array(head | gone))
                yield from rows.select(names).combine_chunks().to_batches()
                begin = end

    def firsts(batches: Batches) -> Batches:
        held = None  # the first line of the last class seen
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            live = rows.filter(pc.invert(rows["gone"]))
            yield from rows.filter(rows["gone"]).select(kept).combine_chunks().to_batches()
            if not len(live):
                continue
            both = live if held is None else pa.concat_tables([held, live])
            head = _heads(both["s1"].to_numpy(), both["s2"].to_numpy())
            gone = _later(both, head)
            out = both.set_column(both.schema.get_field_index("gone"), "gone", pa.array(gone)).filter(pa.array(head | gone))
            yield from out.slice(0 if held is None else 1).select(kept).combine_chunks().to_batches()
            at = int(np.flatnonzero(head)[-1])
            held = both.slice(at, 1).combine_chunks()

    kept = ["doc", "no", "n", "g1", "g2", "keys", "ranks", "gone"]
    made = tokens.mapInArrow(lines, f"doc {_kind(tokens)}, {MARKED}")
    return made.repartition(_parts(tokens), "part").sortWithinPartitions("s1", "s2", "doc", "no").mapInArrow(firsts, f"doc {_kind(tokens)}, no int, n int, g1 long, g2 long, keys binary, ranks binary, gone boolean")


#: What a place tells besides its key and its document.
#: ``pos`` is ``-1 - pos`` of a line that is settled; ``split`` is the exponent of
#: the token's number of blocks, and 64 more where a block meets itself.
PLACE = np.dtype([("g1", "<u8"), ("g2", "<u4"), ("no", "<i4"), ("pos", "<i4"), ("split", "u1")])


def folded(bits: np.ndarray) -> np.ndarray:
    """64 parities as 32."""
    return ((bits ^ bits >> np.uint64(32)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def block_of(place: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mixed(place["g1"] ^ place["g2"], 0x9E3779B97F4A7C15) % blocks.astype(np.uint64)).astype(np.int64)


def places(classes: DataFrame, dealt: bool) -> DataFrame:
    """(spot, doc, no, place): a row for each of the first tokens of a line;
    ``spot`` has the token above and the line's size below.  If ``dealt``, a token
    of many places is split into blocks."""

    def spread(batches: Batches) -> Batches:
        for batch in batches:
            rows = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            size = np.array([len(x) // 4 for x in rows["keys"].to_pylist()], np.int64)
            of = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            key = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int32).astype(np.int64)
            rank = np.frombuffer(b"".join(rows["ranks"].to_pylist()), np.uint8).astype(np.int64)
            # at rank r, a token has 2**(r/2) places at most
            blocks = 1 << np.maximum(0, (rank + 1) // 2 - (HOT.bit_length() - 1)) if dealt else np.ones(len(of), np.int64)
            g1, g2, n = rows["g1"].to_numpy().view(np.uint64), rows["g2"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(of)), blocks)
            other, many = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks), blocks[row]
            of, pos, key = of[row], pos[row], key[row]
            place = np.zeros(len(of), PLACE)
            place["g1"], place["g2"], place["no"] = g1[of], folded(g2[of]), rows["no"].to_numpy()[of]
            place["pos"] = np.where(rows["open"].to_numpy(zero_copy_only=False)[of], pos, -1 - pos)
            own = block_of(place, many)
            place["split"] = np.log2(many).astype(np.uint8) + 64 * (own == other)
            cell = np.minimum(own, other) * many + np.maximum(own, other)
            spot = ((key + cell * 0x9E3779B1) & ((1 << 31) - 1)) << 32 | n[of]
            yield pa.RecordBatch.from_arrays([pa.array(spot), rows["doc"].take(pa.array(of)), pa.array(place["no"]), _binary(place.view(np.uint8).reshape(-1, PLACE.itemsize), np.ones(len(of), np.int64))], ["spot", "doc", "no", "place"])

    return classes.select("doc", "no", "n", "g1", "g2", "keys", "ranks", "open").mapInArrow(spread, f"spot long, doc {_kind(classes)}, no int, place binary")


def _place(rows: pa.Table) -> np.ndarray:
    """The places of a table of one chunk, all of one width."""
    whole = rows["place"].chunk(0)
    begin = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
    return np.frombuffer(whole.buffers()[2], PLACE, len(whole), begin)


def _may(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Length, positional and bitmap filters of pairs of places of lines of n and m."""
    pos, at = (np.where(x < 0, -1 - x, x).astype(np.int64) for x in (a["pos"], b["pos"]))
    need = _overlap(n, m)
    got = np.flatnonzero((5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.minimum(n - pos, m - at) + np.minimum(pos, at) >= need))
    odd = np.bitwise_count(a["g1"][got] ^ b["g1"][got]).astype(np.int64) + np.bitwise_count(a["g2"][got] ^ b["g2"][got])
    return got[odd <= (n + m - 2 * need)[got]]


def _pairs(doc: pa.Array, place: np.ndarray, late: np.ndarray, early: np.ndarray) -> pa.RecordBatch:
    side = lambda k: [doc.take(pa.array(k)), pa.array(place["no"][k])]
    return pa.RecordBatch.from_arrays([*side(late), *side(early)], ["doc", "no", "doc2", "no2"])


def met_first(rows: DataFrame) -> DataFrame:
    """Pairs of a line and one of the leaders at its place.

    The earliest line of a place leads; so does, up to ``LEADERS``, the earliest
    that no leader before it may be similar to.  Work is linear in the lines.
    """

    def meet(batches: Batches) -> Batches:
        held = None  # the leaders of the last place, in order
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            both = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
            old = 0 if held is None else len(held)
            place, doc, n, key = _place(both), both["doc"].chunk(0), both["n"].to_numpy(), both["key"].to_numpy()
            leads, rest = [], np.arange(len(key))
            for _ in range(LEADERS):
                if not len(rest):
                    break
                head = _heads(key[rest])
                first = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))]
                leads.append(rest[head])
                first, rest = first[~head], rest[~head]
                near = np.zeros(len(rest), bool)
                near[_may(place[rest], place[first], n[rest], n[first])] = True
                new = near & (rest >= old)  # pairs of old leaders have been put out
                yield _pairs(doc, place, rest[new], first[new])
                rest = rest[~near]
            leaders = np.sort(np.concatenate(leads))
            held = both.take(pa.array(leaders[key[leaders] == key[-1]])).combine_chunks()

    dealt = rows.select(F.shiftright("spot", 32).cast("int").alias("key"), F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).alias("n"), "doc", "no", "place")
    return dealt.repartition(_parts(rows), "key").sortWithinPartitions("key", "doc", "no").mapInArrow(meet, _pair_schema(rows)).distinct()


def met_all(rows: DataFrame) -> DataFrame:
    """Pairs of lines at a place, of which the later is open."""

    def meet(batches: Batches) -> Batches:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            now = pa.Table.from_batches([batch])
            both = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
            spot = both["spot"].to_numpy()
            yield from _compared(both["doc"].chunk(0), _place(both), spot, 0 if held is None else len(held))
            # what a longer line may still meet
            held = both.filter(pa.array((spot >> 32 == spot[-1] >> 32) & (5 * (spot & 0xFFFFFFFF) >= 4 * (spot[-1] & 0xFFFFFFFF)))).combine_chunks()

    return rows.select("spot", "doc", "place").repartition(_parts(rows), F.shiftright("spot", 32)).sortWithinPartitions("spot").mapInArrow(meet, _pair_schema(rows)).distinct()


def _compared(doc: pa.Array, place: np.ndarray, spot: np.ndarray, begin: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows i < j, j from ``begin`` on, with i the shorter or of equal size."""
    n, no, id_, is_open = spot & 0xFFFFFFFF, place["no"], doc.to_numpy(zero_copy_only=False), place["pos"] >= 0
    block, alone = block_of(place, 1 << (place["split"].astype(np.int64) & 63)), place["split"] >= 64
    index = np.where(is_open, place["pos"], -1 - place["pos"]) < n - _overlap(n, n) + 1
    from_, to = np.maximum(np.arange(len(n)) + 1, begin), np.searchsorted(spot, (spot >> 32 << 32) + 5 * n // 4, "right")
    count = np.where(index, np.maximum(0, to - from_), 0)
    total, at = np.cumsum(count), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        c = count[at:end]
        i = np.repeat(np.arange(at, end), c)
        j = from_[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = end
        # sets of equal size share a token that is among the first of both
        ok = (index[j] | (n[i] != n[j])) & (alone[i] & alone[j] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        near = _may(place[i], place[j], n[i], n[j])
        i, j = i[near], j[near]
        swap = (id_[i] > id_[j]) | ((id_[i] == id_[j]) & (no[i] > no[j]))
        late, early = np.where(swap, i, j), np.where(swap, j, i)
        ok = is_open[late]
        if ok.any():
            yield _pairs(doc, place, late[ok], early[ok])


def _pair_schema(rows: DataFrame) -> str:
    return f"doc {_kind(rows)}, no int, doc2 {_kind(rows)}, no2 int"


def _parts(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slots(doc: pa.Array, of: np.ndarray, no: np.ndarray, size: int) -> np.ndarray:
    """The slot of lines ``no`` of documents ``doc[of]``, of ``size``, a power of two."""
    if pa.types.is_integer(doc.type):
        own = doc.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    else:
        own = np.array([xxhash.xxh3_64_intdigest(str(x)) for x in doc.to_pylist()], np.uint64)
    return (mixed(mixed(own, 0x9E3779B97F4A7C15)[of] + no.astype(np.uint64), 0xC2B2AE3D27D4EB4F) >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)


def lines_asked(pairs: DataFrame):
    """A broadcast bitmap of the lines in ``pairs``; its size grows with them to a bound."""
    size = min(8 * MOST_ASKED, 1 << max(20, (ROOM * pairs.count()).bit_length()))

    def marked(batches: Batches) -> Batches:
        for batch in batches:
            every = np.arange(len(batch))
            slot = np.concatenate([slots(batch.column(k), every, batch.column(k + 1).to_numpy(), size) for k in (0, 2)])
            at, bit = slot // 8, 1 << slot % 8
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(_heads(at[order]))
            if len(heads):
                yield pa.RecordBatch.from_arrays([pa.array(at[order][heads].astype(np.int32)), pa.array(np.bitwise_or.reduceat(bit[order], heads).astype(np.int32))], ["at", "bits"])

    got = pairs.mapInArrow(marked, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 8, np.uint8)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(table)


def verified(pairs: DataFrame, tokens: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(doc, no) of the pairs that are similar, on their whole token sets; the
    pairs are the table ``label``-pairs, which is dropped."""
    held = lines_asked(pairs)

    def picked(batches: Batches) -> Batches:
        bits = held.value
        for batch in batches:
            lens = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(2).to_pylist()]
            if not lens:
                continue
            no, n = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.int32), np.concatenate(lens)
            of = np.repeat(np.arange(len(lens)), [len(x) for x in lens])
            slot = slots(batch.column(0), of, no, 8 * len(bits))
            want = np.flatnonzero(bits[slot // 8] >> (slot % 8).astype(np.uint8) & 1)
            toks, ends = batch.column(3), np.cumsum(n) - np.repeat(np.cumsum([x.sum() for x in lens]) - [x.sum() for x in lens], [len(x) for x in lens])
            got, text, last = [], b"", -1
            for k, i, e, m in zip(of[want].tolist(), want.tolist(), ends[want].tolist(), n[want].tolist(), strict=True):
                text, last = (text, last) if k == last else (toks[k].as_py(), k)
                got.append(text[(e - m) * WIDE : e * WIDE])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[want])), pa.array(no[want]), pa.array(got, pa.binary())], ["doc", "no", "tok"])

    # the bitmap lets some other lines by; repeated rows may give a place two sets, and each is looked at
    sets = scratch.save(tokens.mapInArrow(picked, f"doc {_kind(tokens)}, no int, tok binary"), f"{label}-sets")
    held.unpersist()

    def similar(batches: Batches) -> Batches:
        for batch in batches:
            for begin in range(0, len(batch), 1 << 14):
                some = batch.slice(begin, 1 << 14)
                a, b = some.column(2).to_pylist(), some.column(3).to_pylist()
                size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) // WIDE
                flat = unpacked(b"".join(x for xy in zip(a, b, strict=True) for x in xy)) | np.repeat(np.arange(len(a), dtype=np.uint64) << np.uint64(48), size)
                flat.sort()
                common = np.bincount((flat[1:][flat[1:] == flat[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(a))
                good = pa.array(9 * common >= 4 * size)
                yield pa.RecordBatch.from_arrays([some.column(0).filter(good), some.column(1).filter(good)], ["doc", "no"])

    a, b = sets.select("doc", "no", F.col("tok").alias("t1")), sets.select(F.col("doc").alias("doc2"), F.col("no").alias("no2"), F.col("tok").alias("t2"))
    found = pairs.join(a, ["doc", "no"]).join(b, ["doc2", "no2"]).select("doc", "no", "t1", "t2").mapInArrow(similar, f"doc {_kind(tokens)}, no int").distinct()
    found = scratch.save(found, label)
    for part in ("pairs", "sets"):
        scratch.drop(f"{label}-{part}")
    return found


def removals(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, no): the lines to remove, of ``least`` distinct words or more; ``no`` counts from 0."""
    tokens = scratch.save(tokenised(docs, doc_id, text, least), "tokens", compression="uncompressed")
    order = docs.sparkSession.sparkContext.broadcast(rarity(tokens))
    classes = scratch.save(classes_of(tokens, order), "classes")
    order.unpersist()
    scratch.free()
    able = classes.where(~F.col("gone") & (F.col("n") >= MEETS))
    # the places' shuffle goes before the next step writes its own
    pairs = scratch.save(met_first(places(able.withColumn("open", F.lit(True)), False)), "led-pairs")
    scratch.free()
    settled = verified(pairs, tokens, scratch, "led")
    scratch.free()
    done = able.join(settled.withColumn("done", F.lit(True)), ["doc", "no"], "left").withColumn("open", F.col("done").isNull())
    pairs = scratch.save(met_all(places(done, True)), "met-pairs")
    scratch.free()
    later = verified(pairs, tokens, scratch, "met")
    # the lines of a class that goes, go; so do all but the first of a class
    gone = scratch.save(classes.where("gone").select("doc", "no").unionByName(settled).unionByName(later).distinct(), "gone")
    for name in ("tokens", "classes", "led", "met"):
        scratch.drop(name)
    scratch.free()
    return gone


def without_lines(docs: DataFrame, gone: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their removed lines cut out."""
    of, out = fresh(docs, "of"), fresh(docs, "out")
    numbers = gone.groupBy(F.col("doc").alias(of)).agg(F.collect_set("no").alias(out))
    joined = docs.join(numbers, F.col(doc_id) == F.col(of), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(out, i)), "\n")
    return joined.withColumn(text, F.when(F.col(out).isNull(), F.col(text)).otherwise(left)).drop(of, out)


def counted(docs: DataFrame, gone: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the removed numbers, comma-joined."""
    light = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long").alias("n_lines"))
    numbers = gone.groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("nos")).withColumnRenamed("doc", "doc_id")
    # a repeated id has the lines of each of its rows; numbers past a row's end aren't its own
    own = F.filter("nos", lambda x: x < F.col("n_lines"))
    return light.join(numbers, "doc_id", "left").withColumn("nos", own).select("doc_id", "n_lines", F.coalesce(F.size("nos"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform("nos", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))
