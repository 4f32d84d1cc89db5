"""Hashes of the white-space words of byte buffers, without a step a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from .common import SPACES


def mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = h * np.uint64(by)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Tokens:
    """Words of texts as hashes, whole buffers at a time.

    A word's hash is a polynomial in ``BASE``, modulo 2**64, of random values of
    its bytes; with ``fold``, capitals have the values of their small letters; white
    space has zero.  Differences of running sums give the polynomials of all words at once.
    """

    BASE = 0x5851F42D4C957F2D

    def __init__(self, fold: bool = True):
        self.value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.value[list(SPACES.encode())] = 0
        self.fold = fold
        self.up = self.down = np.zeros(0, np.uint64)

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64-bit hash, begin and end of each word of a buffer."""
        buf = np.frombuffer(raw + b"\n", np.uint8)
        if len(self.up) < len(buf):
            self.up, self.down = _powers(self.BASE, len(buf)), _powers(pow(self.BASE, -1, 1 << 64), len(buf))
        value = self.value[buf]
        sums = np.cumsum(value * self.up[: len(buf)])
        word = value != 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.append(0, edge)
        begin, end = edge[::2], edge[1::2]  # the last byte is white space
        h = (sums[end - 1] - np.where(begin > 0, sums[begin - 1], np.uint64(0))) * self.down[begin]
        return mixed(h, 0x9E3779B97F4A7C15), begin, end

    def vocabulary(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words of some texts, in order of appearance; of each word its number and its text.

        Words are told apart by their 64-bit hashes.
        """
        raw = b"\n".join(texts)
        raw = raw.lower() if self.fold else raw
        h, begin, end = self.spans(raw)
        which, found = pd.factorize(h)  # hashes, not sorts
        at = np.empty(len(found), np.int64)
        at[which[::-1]] = np.arange(len(h))[::-1]
        words = [raw[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        return words, which, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")

    def lines(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """48-bit hash and line number of each word of a buffer."""
        h, begin, _ = self.spans(raw)
        return h >> np.uint64(16), np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), begin)


def portions(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is alone."""
    ends, begin = np.cumsum([len(t) + 1 for t in texts]), 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size)))
        yield begin, stop
        begin = stop
