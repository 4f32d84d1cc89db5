"""URL filters from dated lists, in DataFrame operations only.

List entries say that a pattern joins (``add``) or leaves (``remove``) a list at
a time.  The next entry of the same list and pattern ends each one's validity,
so entries become intervals.  A capture is looked up by each pattern that could
cover it: its host, each domain it is in, and host with the first part of its
path; an as-of join finds those of its patterns' intervals that were valid when
it was fetched.  A hit on an ``allow`` list overrides ``block``.

Entries of the same list, pattern and time: ``remove`` counts after ``add``.
Captures without URL or time match nothing and are kept.  Captures with equal
URL and time are looked up once and each get the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: scheme, user and host of a URL; then the first part of its path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FIRST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*(/[^/?#]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def patterns(url: Column) -> Column:
    """All patterns that could cover a URL."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    first = F.regexp_extract(url, FIRST, 1)
    exact = F.array(F.concat(F.lit("host:"), host(url)))
    return F.when(host(url) == "", F.array().cast("array<string>")).otherwise(F.concat(exact, domains, F.when(first != "", F.array(F.concat(F.lit("prefix:"), host(url), first))).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) of (list, kind, pattern, action, at)."""
    each = W.partitionBy("list", "pattern").orderBy("at", "action")
    return entries.withColumn("until", F.lead("at").over(each)).where("action = 'add' and (until is null or until > at)").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with n_active, lists and blocked."""
    asked = captures.select(F.col(url).alias("u"), F.col(fetched).alias("f")).where("u is not null and f is not null").distinct()
    keys = asked.select("u", "f", F.explode(patterns(F.col("u"))).alias("pattern"))
    # one key may hold a third of the captures: an equi join that may be split
    met = keys.join(intervals(entries), "pattern").where("since <= f and (until is null or f < until)")
    found = met.groupBy("u", "f").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max(F.col("kind") == "allow").alias("a"), F.max(F.col("kind") == "block").alias("b"))
    out = captures.join(found, (captures[url] == found["u"]) & (captures[fetched] == found["f"]), "left")
    return out.withColumns({"n_active": F.coalesce("n_active", F.lit(0)).cast("long"), "lists": F.coalesce("lists", F.lit("")), "blocked": F.coalesce(F.col("b") & ~F.col("a"), F.lit(False))}).drop("u", "f", "a", "b")
