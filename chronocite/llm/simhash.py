"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64-bit SimHashes of word shingles.  Each distinct fingerprint
gets its Hamming distances to ``len(PIVOTS)`` reference fingerprints, computed
once.  Two fingerprints that differ in at most ``limit`` bits differ by at most
as much in every coordinate, so a pair with a larger coordinate difference is
discarded, and the rest are verified bit by bit.

Not all pairs are looked at: with the bits in ``limit`` + k blocks, near
fingerprints agree on at least k of them, so only fingerprints that agree on
some k blocks meet.  k grows with the number of distinct fingerprints, which
keeps the meetings rare; no link is lost at any k.

A meeting of many (near copies in thousands) is walked breadth first: a
fingerprint that has been reached is not compared again, so a dense group costs
about one pass, and only the links of the walk are put out.  A pair is put out
only where its first agreeing blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, Scratch
from .components import components

LIMIT = 4
#: Reference fingerprints: fixed, spread at random over the 64 bits.
PIVOTS = [int(x) for x in np.random.default_rng(64).integers(-(1 << 63), 1 << 63, 16)]
LOWER = bytes(c + 32 if c in UPPER.encode() else c for c in range(256))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """64-bit hashes of the word shingles, in order of place; a shorter text is
    one shingle, no words give none."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer; no words give 0."""
    return fingerprint_of(shingles(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return made(text)


def masks(distinct: int, limit: int = LIMIT) -> list[int]:
    """Bit masks of the block choices, signed; one must agree for a link."""
    keep = 1
    while keep < 6 and (1 << (64 * keep // (keep + limit))) < 4 * distinct:
        keep += 1
    cuts = [64 * k // (keep + limit) for k in range(keep + limit + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(blocks, keep))]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as numpy counts the bits of absolute values."""
    return np.bitwise_count((a ^ b).astype(np.uint64))


def near(fps: np.ndarray, pivots: np.ndarray, one: int, others: np.ndarray, limit: int) -> np.ndarray:
    """Which of ``others`` (row numbers) are within the limit of row ``one``."""
    keep = (np.abs(pivots[others] - pivots[one]) <= limit).all(1)
    keep[keep] = differing(fps[others[keep]], fps[one]) <= limit
    return keep


def walk(fps: np.ndarray, pivots: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a breadth-first walk over the rows, as row numbers."""
    rest, links = np.arange(len(fps)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            got = near(fps, pivots, one, rest, limit)
            links += [(one, int(x)) for x in rest[got]]
            front += rest[got].tolist()
            rest = rest[~got]
    return links


def links_of(table: np.ndarray, fps: np.ndarray, pivots: np.ndarray, ends: np.ndarray, all_masks: np.ndarray, limit: int) -> np.ndarray:
    """Links inside groups of rows; ``ends``: where each group ends."""
    sizes = np.diff(np.concatenate(([0], ends)))
    begin = ends - sizes
    a, b = [], []
    last = np.repeat(ends, sizes)
    small = np.repeat(sizes <= 32, sizes)
    for step in range(1, min(32, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-step] & (np.arange(len(fps) - step) + step < last[:-step]))
        i = i[(np.abs(pivots[i] - pivots[i + step]) <= limit).all(1)]
        i = i[differing(fps[i], fps[i + step]) <= limit]
        a.append(i)
        b.append(i + step)
    for s, e in zip(begin[sizes > 32].tolist(), ends[sizes > 32].tolist(), strict=True):
        if pairs := walk(fps[s:e], pivots[s:e], limit):
            x = np.array(pairs) + s
            a.append(x[:, 0])
            b.append(x[:, 1])
    if not a or not sum(map(len, a)):
        return np.zeros((0, 2), np.int64)
    i, j = np.concatenate(a), np.concatenate(b)
    differ, first = fps[i] ^ fps[j], np.full(len(i), -1)
    for k in range(len(all_masks) - 1, -1, -1):
        first[differ & all_masks[k] == 0] = k
    mine = first == table[i]
    return np.stack([fps[i][mine], fps[j][mine]], 1)


def pivot_columns(fp: Column) -> list[Column]:
    """Distances to the pivots, eight to a long, one byte each."""
    packed = lambda part: sum((F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * k) for k, p in enumerate(part)), F.lit(0).cast("long"))
    return [packed(PIVOTS[:8]).alias("p0"), packed(PIVOTS[8:]).alias("p1")]


def near_links(distinct: DataFrame, count: int, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) that connect what is linked among distinct fingerprints."""
    choice = masks(count, limit)
    choice_array = np.array(choice, np.int64)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            if not len(rows):
                continue
            held.append(rows)
            same = (rows["t"].to_numpy() == rows["t"].iloc[-1]) & (rows["key"].to_numpy() == rows["key"].iloc[-1])
            if same.all() and len(held) > 1 and (held[0]["t"].iloc[-1], held[0]["key"].iloc[-1]) == (rows["t"].iloc[-1], rows["key"].iloc[-1]):
                continue
            whole = pd.concat(held)
            tail = (whole["t"].to_numpy() == rows["t"].iloc[-1]) & (whole["key"].to_numpy() == rows["key"].iloc[-1])
            held = [whole[tail]]
            yield _met(whole[~tail], choice_array, limit)
        if held:
            yield _met(pd.concat(held), choice_array, limit)

    fp = F.col("fp")
    dealt = distinct.select(fp, *pivot_columns(fp), F.explode(F.array(*[F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(choice)])).alias("c")).select("fp", "p0", "p1", "c.t", "c.key")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInPandas(meet, "u long, v long")


def _met(rows: pd.DataFrame, choice: np.ndarray, limit: int) -> pd.DataFrame:
    t, key, fps = (rows[c].to_numpy() for c in ("t", "key", "fp"))
    if len(t) == 0:
        return pd.DataFrame({"u": fps, "v": fps})
    ends = np.append(np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1, len(t))
    pivots = np.stack([rows["p0"].to_numpy(), rows["p1"].to_numpy()], 1).astype("<i8").view(np.uint8).astype(np.int16)
    out = links_of(t, fps, pivots, ends, choice, limit)
    return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})


def groups(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = LIMIT) -> DataFrame:
    """doc_id, th (hash of the text), fp, root and component_id of every row.

    Null and blank texts have fingerprint 0 and are linked like any other.  The
    component is told by its root, one of its fingerprints; component_id is the
    least doc_id in it (null ids aside), which is null where all ids are null
    and may be the same for two components where ids repeat.
    """
    made = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), fingerprints(F.col(text), shingle).alias("fp")), "fingerprints")
    distinct = scratch.save(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(near_links(distinct.select("fp"), distinct.count(), limit), scratch)
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component of ``found`` (doc_id, th, root)
    left: that of the least doc_id (null ids last), then of the least th."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.th").alias("__first"))
    marked = docs.withColumn("__th", F.xxhash64(F.col(text)))
    kept = marked.join(first, marked[doc_id].eqNullSafe(first["__id"]) & (marked["__th"] == first["__first"]), "left_semi")
    return kept.withColumn("__n", F.row_number().over(W.partitionBy(doc_id, "__th").orderBy(F.lit(0)))).where("__n = 1").drop("__th", "__n")


def keep_first(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = LIMIT) -> DataFrame:
    """The documents with one of each group left (``one_of_each``)."""
    return one_of_each(docs, groups(docs, scratch, doc_id=doc_id, text=text, shingle=shingle, limit=limit), doc_id=doc_id, text=text)
