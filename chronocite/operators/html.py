"""Judgment pages to numbered paragraphs, on the standard library's parser.

A router tries formats in a fixed order and takes the first that fits: class
``numbered`` paragraphs, point tables, dt/dd lists, sections with headings,
numbered text, else every paragraph in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {"p", "li", "dd", "dt", "td", "h1", "h2", "h3", "h4", "div"}
NUMBER = re.compile(r"^\s*(\d+)[.\s]\s*")
STOP = re.compile(r"^(On those grounds|Par ces motifs|Aus diesen Gründen|Costs|Dépens)", re.I)


class Blocks(HTMLParser):
    """Blocks of a page as (tag, class, id, text), and its links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.open: list[list] = []
        self.silent = 0
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in BLOCKS:
            ends = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p")}.get(tag, ())
            while self.open and self.open[-1][0] in ends:
                self.close()
            self.open.append([tag, a.get("class") or "", a.get("id") or "", []])
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"], []]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None
        elif tag in BLOCKS and any(b[0] == tag for b in self.open):
            while self.open and self.close() != tag:
                pass

    def close(self):
        tag, cls, ident, parts = self.open.pop()
        if text := " ".join("".join(parts).split()):
            self.blocks.append((tag, cls, ident, text))
        return tag

    def handle_data(self, data):
        if self.silent:
            return
        if self.open:
            self.open[-1][3].append(data)
        if self.anchor:
            self.anchor[1].append(data)


def parse(page: str | None) -> Blocks:
    b = Blocks()
    b.feed(page or "")
    while b.open:
        b.close()
    return b


def in_sequence(texts: list[str]) -> dict[int, str]:
    """Paragraphs numbered strictly from 1; what follows a number belongs to it."""
    out: dict[int, str] = {}
    for t in texts:
        if STOP.match(t) and out:
            break
        m = NUMBER.match(t)
        if m and int(m[1]) == len(out) + 1:
            out[len(out) + 1] = t
        elif out and not m:
            out[len(out)] += " " + t
    return out


def modern(b: Blocks) -> dict[int, str]:
    return in_sequence([t for _, c, _, t in b.blocks if re.search("numero|numbered|count", c, re.I)])


def points(b: Blocks) -> dict[int, str]:
    """Rows marked point1, point2, ...: the text after each marker."""
    out, now = {}, None
    for _, _, ident, t in b.blocks:
        if m := re.fullmatch(r"point(\d+)", ident):
            now = int(m[1])
        elif now and now not in out:
            out[now] = t
    return out


def definitions(b: Blocks) -> dict[int, str]:
    """dt numbers and the dd after each."""
    out, now = {}, None
    for tag, _, _, t in b.blocks:
        if tag == "dt":
            m = re.match(r"\s*(\d+)", t)
            now = int(m[1]) if m else None
        elif tag == "dd" and now == len(out) + 1:
            out[now] = re.split(STOP.pattern.strip("^"), t, flags=re.I)[0].strip()
    return out


def sections(b: Blocks) -> dict[int, str]:
    """Numbered paragraphs after a heading of grounds or judgment."""
    at = next((k for k, (tag, _, _, t) in enumerate(b.blocks) if tag[0] == "h" and re.search("grounds|motifs|gründe|judgment|arrêt|urteil", t, re.I)), None)
    return in_sequence([t for tag, _, _, t in b.blocks[at + 1 :] if tag in ("p", "li", "td")]) if at is not None else {}


def single_block(b: Blocks) -> dict[int, str]:
    """One block that holds all numbers: cut where the next one is due."""
    long = max((t for _, _, _, t in b.blocks), key=len, default="")
    out, at, n = {}, 0, 1
    while m := re.compile(rf"(?:(?<=\s)|^){n}\s+(?=[A-ZÀ-Þ])").search(long, at):
        if n > 1:
            out[n - 1] = long[start : m.start()].strip()
        start, at, n = m.start(), m.end(), n + 1
    if n > 2:
        out[n - 1] = long[start:].strip()
    return out


def plain(b: Blocks) -> dict[int, str]:
    return dict(enumerate((t for tag, _, _, t in b.blocks if tag in ("p", "li")), 1))


ROUTES = (modern, points, definitions, sections, single_block, plain)


def numbered(page: str | None) -> tuple[str, dict[int, str]]:
    """The format that fits first, and its paragraphs."""
    b = parse(page)
    for route in ROUTES:
        if got := route(b):
            return route.__name__, got
    return "none", {}


def articles(page: str | None) -> list[tuple[str, str]]:
    """Articles of an act: headers 'Article N', until a section or the end."""
    out: list[list] = []
    for _, _, _, t in parse(page).blocks:
        if m := re.fullmatch(r"Article (\d+[a-z]?)", t):
            out.append([m[1], []])
        elif re.match(r"(Done at|Section \d)", t):
            if out:
                out.append([None, []])
        elif out:
            out[-1][1].append(t)
    return [(n, " ".join(x)) for n, x in out if n is not None]


def paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, format, number, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, kind, n, t) for k, page in zip(batch["k"], batch["h"], strict=True) for kind, got in [numbered(page)] for n, t in got.items()]
            if out:
                yield pd.DataFrame(out, columns=[key, "format", "number", "text"])

    return pages.selectExpr(f"{key} as k", f"{html} as h").mapInPandas(rows, f"{key} long, format string, number int, text string")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, href, text) of links in page order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, n, href, t) for k, page in zip(batch["k"], batch["h"], strict=True) for n, (href, t) in enumerate(parse(page).links)]
            if out:
                yield pd.DataFrame(out, columns=[key, "pos", "href", "text"])

    return pages.selectExpr(f"{key} as k", f"{html} as h").mapInPandas(rows, f"{key} long, pos int, href string, text string")
