"""Byte-level BPE: overlapping chunk encoding and decoding.

A text is cut into chunks that overlap.  Each chunk is pre-tokenised on its
own; neighbours are stitched at the first boundary that both have inside their
overlap (from there on both read the same text from the same state).  Only then
are the pieces encoded by the merge ranks.  Where an overlap holds no common
boundary, the two chunks become one and are pre-tokenised again.  Decoding
concatenates the raw bytes of the ids.

Null is the empty text: no ids, no bytes.  Very long texts and texts without
any blank give the same ids as a single pass.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Pieces that a worker remembers.
REMEMBERED = 400_000
#: White space before a blank: there, a piece may not end.
DOUBLE = re.compile(r"\s ")

ENCODED = "n_tokens long, ids binary, decoded binary"


def ranks(raw: bytes) -> dict[bytes, int]:
    """Parse a rank file: base64 token, blank, rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def pieces(text: str) -> list[str]:
    """Cut before each blank that follows a non-blank.

    These are pre-token boundaries: no pre-token crosses such a place, and the
    look-ahead of none reaches over it, so each piece, a run of whole
    pre-tokens, can be split by the pattern alone.
    """
    parts = text.split(" ")
    if parts[0] and not DOUBLE.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out if out[0] else out[1:]


def bounds(parts: list[str], start: int) -> list[int]:
    at, out = start, []
    for p in parts:
        out.append(at)
        at += len(p)
    return out


def stitched(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text, from overlapping chunks."""
    if len(text) <= chunk + overlap:
        return pieces(text)
    done: list[str] = []
    begin, stop = 0, min(len(text), chunk + overlap)
    mine = pieces(text[begin:stop])
    while stop < len(text):
        # the neighbour begins inside this chunk and shares `overlap` characters
        after = stop - overlap
        end = min(len(text), stop + chunk)
        theirs = pieces(text[after:end])
        # a boundary where a chunk begins is the cut's own; a last piece may be unfinished
        left = bounds(mine, begin)
        right = bounds(theirs, after)
        common = set(left[1:]) & {b for b in right[1:] if b < stop}
        if common:
            at = min(common)
            done += mine[: left.index(at)]
            mine, begin = theirs[right.index(at) :], at
        else:
            mine = pieces(text[begin:end])
        stop = end
    return done + mine


class Coder:
    """Encoder of pieces with a bounded memory of those seen."""

    def __init__(self, table: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.seen: dict[str, bytes] = {}
        self.raw = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            self.raw[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        seen, out = self.seen, []
        for p in stitched(text):
            got = seen.get(p)
            if got is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                got = seen[p] = array("I", self.encoding.encode_ordinary(p)).tobytes()
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in memoryview(ids).cast("I")])


_coders: dict[int, Coder] = {}


def coded(spark: SparkSession, text: Column, rank_file: bytes, pattern: str) -> Column:
    """A struct column (``ENCODED``): the ids and what they decode to."""
    held = spark.sparkContext.broadcast((rank_file, pattern))
    key = hash((rank_file, pattern))

    @F.pandas_udf(ENCODED)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _coders:
            raw, pat = held.value
            _coders.clear()
            _coders[key] = Coder(ranks(raw), pat)
        coder = _coders[key]
        for texts in batches:
            ids = [coder.encode(t or "") for t in texts]
            yield pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": [coder.decode(x) for x in ids]})

    return code(text)
