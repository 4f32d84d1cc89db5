"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``size`` consecutive words of a benchmark item (a shorter item
is one window) is a pattern.  Texts are normalised to lower-case words with one
space between them; the automaton reads each text once, and the places of the
hits are mapped back to character offsets of the original text.

The windows live in the driver and in each worker, so their size is checked: up
to ``SHARD_BYTES`` of item text make one automaton; a larger benchmark is dealt
into as many shards as needed, read one after another by the same documents.

Nulls and empty texts have no words and are never hit; items without words
have no windows; repeated items are reported by each of their ids.  An item
with a null id is undefined input: its windows are left out, so a document that
holds its passage has no hit by it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Item text that one automaton may hold.
SHARD_BYTES = 8 << 20
#: Bytes outside words become blanks, A-Z become a-z, all else stays.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def normal(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def windows(words: list[bytes], size: int) -> list[tuple[bytes, int]]:
    """Distinct windows as (joined words, number of words)."""
    if not words:
        return []
    n = min(size, len(words))
    return list(dict.fromkeys((b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)))


def patterns(items: list[tuple[str, str | None]], size: int) -> dict[bytes, tuple[int, tuple[str, ...]]]:
    """Pattern -> (words in it, ids of the items that have it)."""
    found: dict[bytes, tuple[int, list[str]]] = {}
    for item_id, text in items:
        for joined, n in windows(normal(text), size):
            found.setdefault(joined, (n, []))[1].append(item_id)
    return {k: (n, tuple(dict.fromkeys(ids))) for k, (n, ids) in found.items()}


_built: dict[str, ahocorasick.Automaton] = {}


def automaton(key: str, pats: dict) -> ahocorasick.Automaton | None:
    """The automaton of a shard, built once in each worker."""
    if key not in _built:
        a = ahocorasick.Automaton()
        for joined, value in pats.items():
            a.add_word(f" {joined.decode('latin-1')} ", value)
        a.make_automaton()
        _built.clear()
        _built[key] = a
    return _built[key] if pats else None


def scan(text: str | None, a: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges (merged, half open), items."""
    words = normal(text)
    if not words or a is None:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    ranges, items = [], set()
    blanks = None
    for end, (n, ids) in a.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        last = int(np.searchsorted(blanks, end))
        ranges.append((last - n, last))
        items.update(ids)
    return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def places(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = lambda at: len(raw[:at].decode())
    return [{"begin": char(int(begins[a])), "end": char(int(ends[b - 1]))} for a, b in ranges]


def hits(benchmark: DataFrame, text: Column, *, item_id: str = "item_id", item_text: str = "text", size: int = 13, shard_bytes: int = SHARD_BYTES) -> Column:
    """A struct column (``HITS``) for ``text`` against all ``benchmark`` items.

    ``items`` are ids as strings, sorted; ``spans`` are merged hits.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_bytes))
    result = None
    for shard in range(n_shards):
        mine = items if n_shards == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_shards)) == shard)
        pats = patterns([(r.i, r.t) for r in mine.collect()], size)
        result = _shard_hits(spark.sparkContext.broadcast(pats), text, result)
    return result


def _shard_hits(held, text: Column, before: Column | None) -> Column:
    """Hits of one shard, added to those of the shards before it."""
    key = uuid.uuid4().hex

    def one(texts: pd.Series, earlier: pd.DataFrame | None) -> pd.DataFrame:
        a = automaton(key, held.value)
        rows = []
        for k, text in enumerate(texts):
            n, ranges, items = scan(text, a)
            if earlier is not None:
                ranges, items = merged([*ranges, *_word_ranges(text, earlier["spans"].iloc[k])]), items | set(earlier["items"].iloc[k])
            rows.append((n, sum(b - a for a, b in ranges), sorted(items), places(text, ranges) if ranges else []))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    if before is None:

        @F.pandas_udf(HITS)
        def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield one(texts, None)

        return first(text)

    @F.pandas_udf(HITS)
    def later(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, earlier in batches:
            yield one(texts, earlier)

    return later(text, before)


def _word_ranges(text: str | None, spans) -> list[tuple[int, int]]:
    count = lambda at: len(normal(text[:at]))
    return [(count(s["begin"]), count(s["end"])) for s in spans]


def contaminated(hit: Column) -> Column:
    """Any hit, and at least one word in twenty."""
    return (hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"])
