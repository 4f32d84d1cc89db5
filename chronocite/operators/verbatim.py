"""Verbatim passages: word runs that a text shares with its sources.

Runs are word-aligned and maximal; those of 3 words and 50 characters or more
count.  Gaps of at most 20 characters between runs are closed.
"""

from __future__ import annotations

import re

LEAST_CHARS, LEAST_WORDS, GAP = 50, 3, 20
WORD = re.compile(r"\S+")


def spans(text: str | None, source: str | None) -> list[tuple[int, int]]:
    """Half-open character ranges of ``text`` that occur in ``source``."""
    if not text or not source:
        return []
    a, b = [*WORD.finditer(text)], [m.group() for m in WORD.finditer(source)]
    words = [m.group() for m in a]
    at: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(b) - LEAST_WORDS + 1):
        at.setdefault(tuple(b[j : j + LEAST_WORDS]), []).append(j)
    found, i = [], 0
    while i + LEAST_WORDS <= len(words):
        best = 0
        for j in at.get(tuple(words[i : i + LEAST_WORDS]), ()):
            n = LEAST_WORDS
            while i + n < len(words) and j + n < len(b) and words[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
        if best and a[i + best - 1].end() - a[i].start() >= LEAST_CHARS:
            found.append((a[i].start(), a[i + best - 1].end()))
            i += best
        else:
            i += 1
    return merged(found)


def merged(found: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def share(text: str | None, found: list[tuple[int, int]]) -> float:
    return sum(e - s for s, e in found) / len(text) if text else 0.0


def masked(text: str, found: list[tuple[int, int]]) -> str:
    for s, e in sorted(found, reverse=True):
        text = f"{text[:s]}<VERBATIM>{text[e:]}"
    return re.sub(r"(<VERBATIM>\s*)+<VERBATIM>", "<VERBATIM>", text).replace("  ", " ")
