"""Identifier codecs of judgments, cases and acts, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGMENT = r"^6(\d{4})C([A-Z])(\d{4})$"


def celex_to_case(celex: Column) -> Column:
    """62010CJ0454 -> C-454/10; anything else gives null."""
    pattern = r"^6(\d{2})(\d{2})([A-Z])J(\d{4})$"
    parts = [F.regexp_extract(celex, pattern, k) for k in (2, 3, 4)]
    return F.when(celex.rlike(pattern), F.concat(parts[1], F.lit("-"), F.regexp_replace(parts[2], "^0+(?=.)", ""), F.lit("/"), parts[0]))


def case_to_celex(case: Column) -> Column:
    """145/90 -> 61990CJ0145; the last four digits of a number count."""
    pattern = r"^\s*(?:([A-Z])-)?(\d+)/(\d{2})\b"
    court, number, year = (F.regexp_extract(case, pattern, k) for k in (1, 2, 3))
    full = F.concat(F.when(year.try_cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), year)
    court = F.when(court == "", F.lit("C")).otherwise(court)
    return F.when(case.rlike(pattern), F.concat(F.lit("6"), full, court, F.lit("J"), F.right(F.lpad(number, F.lit(12), F.lit("0")), F.lit(4))))


def allowed_type(celex: Column) -> Column:
    return F.coalesce(celex.rlike(r"^(6\d{4}CJ|3\d{4}[LR])\d{4}$"), F.lit(False))


def act_year(celex: Column) -> Column:
    """Characters 2 to 5 as a year, where from 1950 to 2025."""
    year = F.substring(celex, 2, 4).try_cast("int")
    return F.when(year.between(1950, 2025), year)


def unit(text: Column) -> Column:
    """Kind of unit of a range entry: by prefix letter, nested form, digits."""
    names = F.create_map(*[F.lit(x) for kv in {"A": "articles", "N": "paragraphs", "P": "pages", "R": "recitals", "L": "lines"}.items() for x in kv])
    letter, nested = F.substring(text, 1, 1), F.regexp_extract(text, r"^\d+([ANPRL])\d+", 1)
    return F.when((text.isNull()) | (text == ""), "unknown").when(letter.isin("A", "N", "P", "R", "L"), names[letter]).when(text.rlike(r"^\d+P\d+"), "articles").when(nested != "", names[nested]).when(text.rlike(r"^\d+$"), "articles").otherwise("paragraphs")


def expand_range(text: Column) -> Column:
    """'N3 - 5 7' -> [3, 4, 5, 7]; nested '08P2' -> [8]; letters stripped."""
    tight = F.regexp_replace(F.trim(text), r"\s*-\s*", "-")
    number = lambda x: F.regexp_extract(F.regexp_replace(x, r"^[A-Z]+", ""), r"^(\d+)", 1).try_cast("int")
    ends = lambda x: F.split(x, "-")
    one = lambda x: F.when(number(F.get(ends(x), F.lit(1))) >= number(F.get(ends(x), F.lit(0))), F.sequence(number(F.get(ends(x), F.lit(0))), number(F.get(ends(x), F.lit(1))))).otherwise(F.array(number(F.get(ends(x), F.lit(0)))))
    return F.array_compact(F.array_distinct(F.flatten(F.transform(F.split(tight, r"\s+"), one))))


def epoch(iso: Column) -> Column:
    """Seconds of an ISO date at midnight UTC; 0 for what is no date."""
    return F.coalesce(F.unix_date(F.try_to_date(iso, "yyyy-MM-dd")).cast("long") * 86400, F.lit(0).cast("long"))
