"""Text cleaning and masking of citations, dates and verbatim passages.

The order is fixed: white space, paragraph number, citations, dates, spacing,
repeated tags, false tags.  Patterns are plain and linear; all run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Month names, whole and short, and citation markers in English and French.
MONTHS = (
    "January Jan February Feb March Mar April Apr May June Jun July Jul August Aug September Sept Sep October Oct November Nov December Dec "
    "janvier janv février fév mars avril avr mai juin juillet juil août septembre sept octobre oct novembre nov décembre déc"
)
DASH = "[-‐-—−­]"
NUMBER = rf"(?:[CTF]\s*{DASH}?\s*)?\d{{1,4}}/\d{{2,4}}(?:\s+(?:P|PPU|R|REV|RX)\b)?"
CASE = rf"(?iU)\b(?:joined\s+cases?|cases?|affaires?(?:\s+jointes)?)\s+{NUMBER}(?:\s*(?:,|and|et|to|à|&|{DASH})\s*{NUMBER})*"
REPORT = rf"(?iU)(?:\[\d{{4}}\]\s+)?\b(?:ECR|Rec\.?)\s+(?:[IVX]+\s*{DASH}\s*)?\d+|\[(?:19|20)\d{{2}}\]|\b(?:ECLI:)?EU:[CTF]:\d{{4}}:\d+"
PARAGRAPH = rf"(?iU)\b(?:paragraphe?s?|paras?\.?|points?|alinéas?|al\.)\s+\d+(?:\s*(?:,|and|et|to|through|à|&|{DASH})\s*\d+)*"
_MONTH, _DAY, _YEAR = f"(?:{'|'.join(MONTHS.split())})", r"\d{1,2}(?:st|nd|rd|th|er)?", r"(?:19|20)\d{2}"
#: In this order; a bare year stays in brackets, before ')', after '/' and 'No'.
DATES = (
    rf"\b\d{{1,2}}[./\s-]\d{{1,2}}[./\s-]{_YEAR}\b",
    rf"\b{_YEAR}[./\s-]\d{{1,2}}[./\s-]\d{{1,2}}\b",
    rf"(?iU)\b{_MONTH}\s+{_DAY},?\s+{_YEAR}\b",
    rf"(?iU)\b{_DAY}\s+{_MONTH},?\s*{_YEAR}\b",
    rf"(?iU)\b{_YEAR}\s+{_MONTH}\s+{_DAY}\b",
    rf"(?i)(?<![/\[\d])(?<!No\s)\b{_YEAR}\b(?![\])/])",
)
JOURNAL = r"\(OJ\s+\d{4}[^)]+\)"


def whitespace(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def without_number(t: Column) -> Column:
    """A leading paragraph number goes, but not in 'NN of ['; blanks at the end
    stay."""

    def bare(x: Column) -> Column:
        rest = F.when(x.rlike(r"^\s*\d+\s+of\s+\["), x).otherwise(F.regexp_replace(x, r"^\s*\d+[.)]?\s*", ""))
        return F.concat(F.trim(rest), F.repeat(F.lit(" "), F.length(x) - F.length(F.rtrim(x))))

    return let(t, bare)


def _replaced(t: Column, pattern: str, tag: str, needs: str) -> Column:
    """Replace a costly pattern only in texts that hold what every match needs."""
    return let(t, lambda x: F.when(x.rlike(needs), F.regexp_replace(x, pattern, tag)).otherwise(x))


def without_citations(t: Column) -> Column:
    t = _replaced(t, CASE, "<CASE>", r"\d/\d\d")
    t = _replaced(t, REPORT, "<CASE>", r"(?i)\bECR|\bRec|EU:[CTF]:|\[(?:19|20)\d\d\]")
    return _replaced(t, PARAGRAPH, "<PARAGRAPH>", r"(?i)(?:para[a-z]*|points?|alin\S*|al)\.?\s+\d")


def without_dates(t: Column) -> Column:
    """Dates become <DATE>; references '(OJ 2004 ...)' stay whole."""

    def masked(x: Column) -> Column:
        for p in DATES:
            x = F.regexp_replace(x, p, "<DATE>")
        return x

    def apart(x: Column) -> Column:
        kept = F.regexp_extract_all(x, F.lit(f"({JOURNAL})"), F.lit(1))
        return F.array_join(F.zip_with(F.transform(F.split(x, JOURNAL), masked), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # every form has a year
    return let(t, lambda x: F.when(~x.rlike(_YEAR), x).when(x.contains("(OJ"), apart(x)).otherwise(masked(x)))


def spacing(t: Column) -> Column:
    """Blanks around commas, full stops, brackets and inside quotes."""
    for p, r in ((r"\s+([,.])", "$1"), (r"([,.])\s+", "$1 "), (r"\s+\)", ")"), (r"\(\s+", "("), (r"(\s)?'\s*([^']+?)\s*'(\s)?", "$1'$2'$3"), (r" {3,}", "  ")):
        t = F.regexp_replace(t, p, r)
    return F.trim(t)


_ONE = "<CASE>"
_CHAIN = rf"{_ONE}(?:,?\s*{_ONE}|\s*\(\s*{_ONE}\s*\)|\s*\[\s*{_ONE}\s*\]|\s*\(+\s*<DATE>\s*\)+\s*{_ONE}|\s*<DATE>\s*{_ONE})+"


def single_tags(t: Column, deep: int = 3) -> Column:
    """Case tags that follow each other become one, through brackets and dates as
    well, to ``deep`` levels of brackets.

    Where some did, 'and' or 'et' between the tags of '<CASE>, <PARAGRAPH>, and
    <CASE>' goes.
    """

    def joined(x: Column) -> Column:
        out = x
        for _ in range(deep):
            out = F.regexp_replace(out, _CHAIN, _ONE)
        bare = lambda y: F.regexp_replace(y, rf"{_ONE},\s+<PARAGRAPH>,\s+(?:and|et|&)\s+{_ONE}", f"{_ONE}, <PARAGRAPH>, {_ONE}")
        return F.when(x.contains(f"{_ONE}, {_ONE}") | x.contains(f"{_ONE} {_ONE}"), bare(out)).otherwise(out)

    return let(t, lambda x: F.trim(F.when(x.contains(_ONE), joined(x)).otherwise(x)))


def clean(t: Column, *, citations: bool = True, dates: bool = True, numbers: bool = True) -> Column:
    t = whitespace(t)
    if numbers:
        t = without_number(t)
    if citations:
        t = without_citations(t)
    if dates:
        t = without_dates(t)
    return without_false_tags(single_tags(spacing(t)))


def number_ranges(t: Column) -> Column:
    """(start, end) of numbers joined by a dash, to, à, and, et: overlapping
    ones too, so every number is tried as a start."""
    starts = F.regexp_extract_all(t, F.lit(r"(\d+(?=\s*(?:-|–|to|à|and|et)\s*\d+))"), F.lit(1))
    ends = F.regexp_extract_all(t, F.lit(r"\d(?=\s*(?:-|–|to|à|and|et)\s*(\d+))"), F.lit(1))
    return F.array_distinct(F.zip_with(starts, ends, lambda a, b: F.struct(a.try_cast("int").alias("start"), b.try_cast("int").alias("end"))))


def language_text(t: Column) -> Column:
    """For language detection: no tags, lower case, single blanks; short: null."""
    flat = F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, r"<[A-Z]+>", " ")), r"\s+", " "))
    return F.when(F.length(flat) >= 20, flat)


def without_false_tags(t: Column) -> Column:
    """((<DATE>)) loses its brackets; a <CASE> swallows a date or case tag before it."""
    for p, r in ((r"\(\(<DATE>\)\)", "<DATE>"), (r"<DATE>\s+<CASE>", "<CASE>"), (r"<CASE>\s+<CASE>", "<CASE>")):
        t = F.regexp_replace(t, p, r)
    return F.trim(t)


def words(t: Column) -> Column:
    """Distinct lower-case words of three letters or more; what has digits,
    hyphens or apostrophes in it is none."""
    tokens = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_'-]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(tokens, lambda x: x.rlike(r"^\p{L}{3,}$")), F.lower))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
