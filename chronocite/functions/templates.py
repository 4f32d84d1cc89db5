"""Texts around texts: model input templates, links, language codes, highlights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter codes of the official languages and their two-letter forms.
LANGUAGES = {
    "bul": "BG", "ces": "CS", "dan": "DA", "deu": "DE", "ell": "EL", "eng": "EN", "est": "ET", "fin": "FI", "fra": "FR", "gle": "GA", "hrv": "HR", "hun": "HU",
    "ita": "IT", "lav": "LV", "lit": "LT", "mlt": "MT", "nld": "NL", "pol": "PL", "por": "PT", "ron": "RO", "slk": "SK", "slv": "SL", "spa": "ES", "swe": "SV",
}
CELEX_URL = "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"


def language_code(code: Column) -> Column:
    """Two upper-case letters of a two- or three-letter code; an unknown code
    stays as it is, in upper case."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(code)), F.upper(code))


def celex_url(celex: Column) -> Column:
    """Null for null and empty."""
    return F.when(celex != "", F.concat(F.lit(CELEX_URL), celex))


def uri_of(url: Column) -> Column:
    """The value of the query's ``uri``."""
    return F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("uri")))


def listed(items: Column) -> Column:
    """Items that aren't null or empty, joined by '. '."""
    return F.coalesce(F.array_join(F.filter(items, lambda x: x != ""), ". "), F.lit(""))


def block(subject: Column, keywords: Column, about: Column) -> Column:
    """The metadata lines that have content, a blank line between; ``about`` is a
    map, of which the values count."""
    lines = [F.when(v != "", F.concat(F.lit(f"{name}: "), v)) for name, v in (("Subject", listed(subject)), ("Keywords", listed(keywords)), ("About", listed(F.map_values(about))))]
    return F.concat_ws("\n\n", *lines)


def model_text(text: Column, metadata: Column | None = None, *, query: bool, prefix: bool = True) -> Column:
    """Prefixed text, under its metadata block if that has content."""
    own = F.concat(F.lit("query: " if query else "passage: "), text) if prefix else text
    return own if metadata is None else F.when(metadata != "", F.concat(metadata, F.lit("\n\n\n"), own)).otherwise(own)


def highlight_terms(title: Column, number: Column, date: Column) -> Column:
    """Distinct words to mark, the longest first, then by spelling.

    Of a title words of three characters or more, of a number its compact forms
    and their parts of two or more, of a date its years.
    """
    none = F.array().cast("array<string>")
    part = lambda t, n: F.filter(F.split(t, r"\W+"), lambda x: F.length(x) >= n)
    compact = F.regexp_extract_all(number, F.lit(r"([A-Za-z0-9][A-Za-z0-9/-]*)"), F.lit(1))
    years = F.regexp_extract_all(date.cast("string"), F.lit(r"\b(\d{4})\b"), F.lit(1))
    found = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in (part(title, 3), compact, part(number, 2), years)]))
    sized = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.transform(sized, lambda s: s["x"])


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlighted(text: Column, terms: Column) -> Column:
    """Escaped text in a box, the terms marked where they stand alone; case aside."""
    safe = F.coalesce(escaped(text), F.lit(""))
    quoted = F.transform(terms, lambda t: F.regexp_replace(t, r"([\\\[\](){}.*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])("), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])"))
    marked = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.regexp_replace(safe, pattern, F.lit('<mark class="hl">$1</mark>'))).otherwise(safe)
    return F.concat(F.lit('<div class="para-box">'), marked, F.lit("</div>"))
