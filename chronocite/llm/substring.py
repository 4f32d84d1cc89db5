"""Substring dedup: suffix automata over reference shards.

A word goes if some window of ``size`` consecutive words that covers it also
starts in a document with a smaller id.

Which text can matter is found first, without loss.  Of each window the least
hash of its ``GRAM``-word grams is its anchor; equal windows have equal anchors,
so only windows whose anchor occurs in two documents are looked at.  Runs of
windows with one anchor (blocks) go to the shard of that anchor, equal blocks
once, under their least id.  A shard takes the blocks of an anchor in ascending
order of ids: it streams each through the suffix automaton of the blocks
before, whose matching statistics give the windows that a smaller id has, and
then adds to the automaton what it had not seen.  So an automaton holds each
distinct passage once, however many documents share it, and it is sent nowhere.

Null and blank texts have no words.  Rows with a null id lose nothing and cost
others nothing.  Rows with equal ids don't count against each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

GRAM = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _pow or len(_pow[0]) < n:
        m = max(n, 1 << 15)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _pow[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(m - 1, x, np.uint64)))) for x in (_ODD, inverse)]
    return _pow[0], _pow[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(words: list[bytes], k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    h = xxhash.xxh64_intdigest
    w = np.fromiter((h(x) for x in words), np.uint64, len(words))
    up, down = _powers(len(w) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(w * up[: len(w)], dtype=np.uint64)))
    return mixed((total[k:] - total[:-k]) * down[: len(w) - k + 1])


def least(a: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    m, size = a, 1
    while size * 2 <= n:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    return np.minimum(m[: len(m) - (n - size)], m[n - size :]) if size < n else m


def anchors(words: list[bytes], size: int) -> np.ndarray:
    """The anchor of each window, as signed integers."""
    return least(grams(words, GRAM), size - GRAM + 1).view(np.int64) if len(words) >= size else np.zeros(0, np.int64)


def split(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class Automaton:
    """A suffix automaton over words that grows by texts."""

    def __init__(self) -> None:
        self.link, self.length, self.next = [-1], [0], [{}]

    def add(self, words: list) -> None:
        link, length, step = self.link, self.length, self.next
        last = 0
        for w in words:
            q = step[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, w, q)
                continue
            new = len(link)
            link.append(0)
            length.append(length[last] + 1)
            step.append({})
            p = last
            while p >= 0 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p >= 0:
                q = step[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        link, length, step = self.link, self.length, self.next
        copy = len(link)
        link.append(link[q])
        length.append(length[p] + 1)
        step.append(dict(step[q]))
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matches(self, words: list) -> list[int]:
        """For each word, the longest match that ends with it."""
        link, length, step = self.link, self.length, self.next
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in step[at]:
                at = link[at]
                n = length[at]
            to = step[at].get(w)
            if to is None:
                at, n = 0, 0
            else:
                at, n = to, n + 1
            out.append(n)
        return out


def repeated_windows(blocks: list[tuple[int, bytes]], size: int) -> list[str]:
    """For blocks of one anchor in ascending id order: which of their windows a
    smaller id has, as a string of 0 and 1."""
    grown, out, at = Automaton(), [], 0
    while at < len(blocks):
        same = at
        fresh = []
        while same < len(blocks) and blocks[same][0] == blocks[at][0]:
            words = blocks[same][1].split()
            seen = [n >= size for n in grown.matches(words)[size - 1 :]]
            out.append("".join("01"[x] for x in seen))
            k = 0
            while k < len(seen):
                if seen[k]:
                    k += 1
                    continue
                stop = k
                while stop < len(seen) and not seen[stop]:
                    stop += 1
                fresh.append(words[k : stop + size - 1])
                k = stop
            same += 1
        if same < len(blocks):
            for words in fresh:
                grown.add(words)
        at = same
    return out


def cut_blocks(text: str | None, shared: set[int] | np.ndarray, size: int) -> list[dict]:
    """Runs of windows with one anchor, of those in ``shared``."""
    words = split(text)
    a = anchors(words, size)
    if not len(a):
        return []
    good = np.isin(a, np.asarray(shared, np.int64))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    out = []
    for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        turns = [begin, *(np.flatnonzero(a[begin + 1 : end] != a[begin : end - 1]) + begin + 1).tolist(), end]
        for i, j in zip(turns, turns[1:], strict=False):
            body = b" ".join(words[i : j + size - 1])
            out.append({"anchor": int(a[i]), "begin": i, "digest": hashlib.sha256(body).digest()[:16], "body": body})
    return out


def removals(docs: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", size: int = 50) -> DataFrame:
    """(doc_id, gone): ranges of word numbers to remove, of documents with any."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")

    @F.pandas_udf("array<long>")
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(anchors(split(t), size)) for t in texts], dtype=object)

    # only documents of a window or more can hold one
    each = scratch.save(rows.where(F.length("text") >= 2 * size - 1).select("doc_id", F.explode(listed("text")).alias("anchor")), "anchors")
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    mine = each.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))

    @F.pandas_udf("array<struct<anchor:long,begin:int,digest:binary,body:binary>>")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([cut_blocks(t, s, size) for t, s in zip(texts, lists, strict=True)], dtype=object)

    blocks = scratch.save(rows.join(mine.hint("merge"), "doc_id").select("doc_id", F.explode(blocked("text", "shared")).alias("b")).select("doc_id", "b.*"), "blocks")
    scratch.drop("anchors")

    # blocks of one text: the least id, and whether others follow
    once = blocks.groupBy("anchor", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("body").alias("body"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def flush():
            if len(held) > 1:
                marks = repeated_windows([(d, b) for d, b, _ in held], size)
            else:
                marks = ["0" * (len(b.split()) - size + 1) for _, b, _ in held]
            return pd.DataFrame({"anchor": [now] * len(held), "digest": [g for _, _, g in held], "least": [d for d, _, _ in held], "marks": marks, "n": [len(m) for m in marks]})

        for batch in batches:
            done = []
            for anchor, doc, body, digest in zip(batch["anchor"], batch["doc_id"], batch["body"], batch["digest"], strict=True):
                if anchor != now:
                    if held:
                        done.append(flush())
                    now, held = anchor, []
                held.append((doc, body, digest))
            if done:
                yield pd.concat(done)
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    judged = once.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id").mapInPandas(stream, "anchor long, digest binary, least long, marks string, n int")
    # a later document with the same block loses all of it, the first what the automaton found
    hit = blocks.select("doc_id", "anchor", "digest", "begin").join(judged, ["anchor", "digest"]).withColumn("marks", F.when(F.col("doc_id") > F.col("least"), F.expr("repeat('1', n)")).otherwise(F.col("marks"))).where("instr(marks, '1') > 0")

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def ranges(parts: pd.Series) -> pd.Series:
        return pd.Series([covered([(p["begin"], p["marks"]) for p in row], size) for row in parts], dtype=object)

    gone = hit.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "marks")).alias("parts")).select("doc_id", ranges("parts").alias("gone"))
    return scratch.save(gone, "gone")


def covered(parts: list[tuple[int, str]], size: int) -> list[dict]:
    """Merged ranges of words that marked windows cover."""
    out: list[list[int]] = []
    for i in sorted(b + k for b, marks in parts for k, x in enumerate(marks) if x == "1"):
        if out and i <= out[-1][1]:
            out[-1][1] = i + size
        else:
            out.append([i, i + size])
    return [{"begin": a, "end": b} for a, b in out]


def kept_words(text: str | None, gone) -> tuple[int, list[bytes]]:
    words = split(text)
    n = len(words)
    if gone is not None:
        for r in reversed(list(gone)):
            del words[r["begin"] : r["end"]]
    return n, words


KEPT = "n_words long, n_removed long, kept_sha256 string"


def digests(text: Column, gone: Column) -> Column:
    """A struct column (``KEPT``) of what is left of each text."""

    @F.pandas_udf(KEPT)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for t, g in zip(texts, lists, strict=True):
                n, left = kept_words(t, g)
                rows.append((n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    return made(text, gone)


def kept_text(text: Column, gone: Column) -> Column:
    """The kept words, joined by one blank."""

    @F.pandas_udf("string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([b" ".join(kept_words(t, g)[1]).decode() for t, g in zip(texts, lists, strict=True)], dtype="string")

    return made(text, gone)
