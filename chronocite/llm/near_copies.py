"""Near copies: SimHash fingerprints with pivot tables, verified and completed.

A document is the set of its hashed word shingles.  Two are linked if their
Jaccard similarity is ``4/5`` or more, and every link is verified on the sets;
groups are the components of the links.  Equal sets, and texts without words,
are one class.

Fingerprints propose first (``simhash.near_links``, on 64-bit SimHashes of the
same shingles): those within ``simhash.LIMIT`` bits, by their distances to the
pivots, and equal ones.  What the sets bear out is joined.  Copies at 0.8 mostly
differ in more bits, so an exact join of the sets then looks for the links
between groups that the fingerprints have left apart; no pair that these have
joined is looked at again.

Shingles are ordered by rarity: counts of all documents in ``BINS`` hash bins
give the order, the hash breaks ties.  The counts only spare work, any order is
exact: two similar sets share one of their first ``n - ceil(4n/5) + 1``
shingles, so only sets that share one meet.  Lengths, positions and a parity
bitmap, which grows with the set, discard most meetings.

Each meeting place is first compared with its least class, which joins dense
groups in linear work; then classes that this has left in different groups meet
wherever at least one of them is not in the group of the place's least class.
Pairs inside a group need no look: they can't change the groups.

Null, empty and blank texts are equal sets; an empty table has no groups;
repeated rows are one class; rows with a null id are grouped like others; texts
of any length are taken whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components
from .line_dedup import _overlap
from .simhash import fingerprint_of, near_links, one_of_each, shingles

#: Bins of the counts, least bits of the bitmaps, bytes of the one that tells which texts are asked for.
BINS, WIDE, ASKED = 1 << 18, 1024, 1 << 20

KEYS = "h long, fp long, n int, sig binary, prefix array<int>"


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingles(text, shingle))


def order_of(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """The order of the bins, from the counts of all documents: 7 bits a bin."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, np.int64)
        for rows in batches:
            for t in rows["text"]:
                total += np.bincount((shingles(t, shingle) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) if t and len(t) > BINS else 0
            short = [shingles(t, shingle) for t in rows["text"] if t and len(t) <= BINS]
            if short:
                total += np.bincount((np.concatenate(short) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bin": used, "c": total[used]})

    sums = docs.select(F.col(text).alias("text")).mapInPandas(count, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()
    order = np.zeros(BINS, np.uint8)
    order[sums["bin"].to_numpy()] = np.minimum(127, 1 + np.floor(4 * np.log2(sums["c"].to_numpy())))
    return order


def keyed(text: str | None, shingle: int, order: np.ndarray) -> tuple[int, int, int, bytes, np.ndarray]:
    """Hash of the set, the fingerprint, the set's size, its bitmap and its first shingles."""
    hashes = shingles(text, shingle)
    s = np.unique(hashes)
    n = len(s)
    ranked = order[(s & np.uint64(BINS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(57) | s >> np.uint64(7)
    some = n - (4 * n + 4) // 5 + 1 if n else 0
    first = np.sort(np.partition(ranked, some - 1)[:some]) if 0 < some < n else np.sort(ranked)[:some]
    wide = max(WIDE, 1 << max(0, n - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    short = (first ^ first >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if n else 0, fingerprint_of(hashes), n, np.packbits(odd.astype(bool)).tobytes(), short


def _apart(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the longer folded to the shorter's width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), 0) if len(z) > n else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def meeting(places: DataFrame) -> DataFrame:
    """Places (key, h, n, pos) of two classes or more, with the least class."""
    columns = ["key", "h", "n", "pos"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, told, last = None, False, None  # the last key's first row, whether it was put out, the last row
        for rows in batches:
            if not len(rows):
                continue
            key, h = rows["key"].to_numpy(), rows["h"].to_numpy()
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            fresh[0] = last != (key[0], h[0])
            last = (key[-1], h[-1])
            rows = rows[fresh]
            if not len(rows):
                continue
            whole = rows if held is None else pd.concat([held, rows])
            key = whole["key"].to_numpy()
            head = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
            out = ~head
            out[first[out]] = True  # firsts that others share
            if told and held is not None:
                out[0] = False
            got = whole[out].reset_index(drop=True)
            yield pd.concat([got, whole.iloc[first[out]][["h", "n", "pos"]].add_prefix("e_").reset_index(drop=True)], axis=1)
            at = int(first[-1])
            told = bool(at < len(key) - 1 or (at == 0 and held is not None and told))
            held = whole.iloc[[at]]

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.select(*columns).repartition(n, "key").sortWithinPartitions("key", "h").mapInPandas(meet, "key int, h long, n int, pos int, e_h long, e_n int, e_pos int")


def _may(a: str, b: str) -> Column:
    """Length and positional filters of rows with n and pos."""
    n, pos, m, at = (F.col(c) for c in (f"{a}n", f"{a}pos", f"{b}n", f"{b}pos"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (1 + F.least(n - pos - 1, m - at - 1) + F.least(pos, at) >= _overlap(n, m))


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, label: str, *, text: str, shingle: int) -> DataFrame:
    """The pairs of classes (u, v) that are similar."""

    @F.pandas_udf("boolean")
    def close(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=bool)
        total = (n + m).to_numpy().astype(np.int64)
        odd = np.fromiter(map(_apart, a, b), np.int64, len(n))
        return pd.Series(odd <= total - 2 * ((4 * total + 8) // 9))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([_set(t, shingle).tobytes() for t in texts], dtype=object)

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        got = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate((x, y)), kind="stable")
            got.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
        return pd.Series(got, dtype=bool)

    side = lambda c: classes.select(F.col("h").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "th", "sig")])
    left = scratch.save(pairs.join(side("u"), "u").join(side("v"), "v").where(close("n_u", "n_v", "sig_u", "sig_v")).select("u", "v", "th_u", "th_v"), f"{label}-pairs")
    # sets are made again, of the texts asked for
    asked = left.select(F.col("th_u").alias("th")).unionByName(left.select(F.col("th_v").alias("th")))
    slot = F.pmod("th", F.lit(8 * ASKED))
    marks = asked.select(F.floor(slot / 8).cast("int").alias("at"), F.expr("shiftleft(1, cast(pmod(th, 8) as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").cast("int").alias("bits")).toArrow()
    table = np.zeros(ASKED, np.uint8)
    table[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def wanted(th: pd.Series) -> pd.Series:
        at = th.to_numpy() % (8 * ASKED)
        return pd.Series(held.value[at // 8] >> (at % 8).astype(np.uint8) & 1 == 1)

    some = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("t")).where(wanted("th")).dropDuplicates(["th"])
    sets = scratch.save(some.select("th", whole("t").alias("s")), f"{label}-sets")
    a, b = sets.select(F.col("th").alias("th_u"), F.col("s").alias("s_u")), sets.select(F.col("th").alias("th_v"), F.col("s").alias("s_v"))
    links = scratch.save(left.join(a, "th_u").join(b, "th_v").where(similar("s_u", "s_v")).select("u", "v"), f"{label}-links")
    for part in ("pairs", "sets"):
        scratch.drop(f"{label}-{part}")
    held.unpersist()
    scratch.free()
    return links


def proposed(made: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of classes (u, v) whose fingerprints are equal or near.

    A set may have several fingerprints, as repeats count in these.  The least
    class of a fingerprint stands for it; the others there meet that one.
    """
    held = scratch.save(made.select("fp", "h").distinct(), "fingerprints")
    least = scratch.save(held.groupBy("fp").agg(F.min("h").alias("least")), "fingerprints-least")
    equal = held.join(least, "fp").where("h != least").select(*_pairs("least", "h"))
    near = near_links(least.select("fp"), least.count()).distinct()
    side = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    other = near.join(side("u"), "u").join(side("v"), "v").where("least_u != least_v").select(*_pairs("least_u", "least_v"))
    return equal.unionByName(other).distinct()


def groups(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, th (hash of the text) and root (that of the group) of every row."""
    order = docs.sparkSession.sparkContext.broadcast(order_of(docs, text, shingle))

    @F.pandas_udf(KEYS)
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([keyed(t, shingle, order.value) for t in texts], columns=["h", "fp", "n", "sig", "prefix"])

    made = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), keys(F.col(text)).alias("k")).select("doc_id", "th", "k.*"), "sets")
    classes = scratch.save(made.groupBy("h").agg(F.min(F.struct("th", "n", "sig")).alias("f")).select("h", "f.*"), "classes")
    check = lambda pairs, label: verified(pairs, classes, docs, scratch, label, text=text, shingle=shingle)
    borne = check(proposed(made, scratch), "borne")
    joined = scratch.save(components(borne, scratch, "borne"), "joined")
    for part in ("fingerprints", "fingerprints-least"):
        scratch.drop(part)
    scratch.free()
    met = scratch.save(meeting(made.select("h", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "h", "n", "pos")), "met")
    side = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    open_ = met.where(F.col("h") != F.col("e_h")).where(_may("", "e_")).select(*_pairs("h", "e_h")).distinct()
    open_ = open_.join(side("u"), "u", "left").join(side("v"), "v", "left").where("coalesce(root_u, u) != coalesce(root_v, v)").select("u", "v")
    led = scratch.save(borne.unionByName(check(open_, "led")), "linked")
    roots = components(led, scratch, "led").withColumnRenamed("node", "h")
    rooted = scratch.save(met.select("key", "h", "n", "pos", "e_h").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "rooted")
    scratch.free()
    lead = rooted.where("h = e_h").select("key", F.col("root").alias("e_root"))
    apart = scratch.save(rooted.join(lead, "key").where("root != e_root").drop("e_root"), "apart")
    x, y = apart.alias("x"), rooted.drop("e_h").alias("y")
    crossed = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.h") != F.col("x.e_h")) & _may("x.", "y."))
    links = led.unionByName(check(crossed.select(*_pairs("x.h", "y.h")).distinct(), "crossed"))
    linked = components(links, scratch, "all").withColumnRenamed("node", "h")
    for part in ("met", "rooted", "apart", "joined"):
        scratch.drop(part)
    order.unpersist()
    return made.select("doc_id", "th", "h").join(linked, "h", "left").select("doc_id", "th", F.coalesce("root", "h").alias("root"))


def keep_first(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """The documents with one of each group left (``simhash.one_of_each``)."""
    return one_of_each(docs, groups(docs, scratch, doc_id=doc_id, text=text, shingle=shingle), doc_id=doc_id, text=text)
