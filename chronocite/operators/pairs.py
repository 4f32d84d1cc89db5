"""Paragraph pairs from citations, and lookups by paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("celex_from", "number_from", "celex_to", "number_to")


def numbered(number: Column, text: Column) -> Column:
    """The text with its number before it once, whether it had it or not."""
    t, own = F.trim(text), number.cast("string")
    has = F.regexp_extract(t, r"^(\d+)", 1) == own
    return F.trim(F.concat(own, F.lit(" "), F.when(has, F.regexp_replace(t, r"^\d+[. \t\r\n]*", "")).otherwise(t)))


def considered(citations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each pair (citing x cited number) of a paragraph-to-paragraph citation,
    with both texts and the reason why it is kept or not.

    ``citations``: celex_from, target, from, unit, to, cited_unit.
    ``paragraphs``: celex, number, text, unique by the first two.  Joins are by
    paragraph, so a case that many cite is spread over its paragraphs.
    """
    usable = citations.where("unit = 'paragraphs' and cited_unit = 'paragraphs' and contains(target, 'CJ')")
    pairs = usable.select("celex_from", F.col("target").alias("celex_to"), F.explode("from").alias("number_from"), "to").select("celex_from", "celex_to", "number_from", F.explode("to").alias("number_to"))
    side = lambda end: paragraphs.select(F.col("celex").alias(f"celex_{end}"), F.col("number").alias(f"number_{end}"), F.col("text").alias(f"text_{end}"))
    cases = paragraphs.select(F.col("celex").alias("celex_to")).distinct().withColumn("known", F.lit(True))
    full = pairs.join(side("from"), ["celex_from", "number_from"], "left").join(side("to"), ["celex_to", "number_to"], "left").join(cases, "celex_to", "left")
    reason = (
        F.when(F.expr("celex_from = celex_to"), "dropped_self").when(F.col("text_from").isNull(), "from_missing").when(F.col("known").isNull(), "target_case_missing")
        .when(F.col("text_to").isNull(), "target_paragraph_missing").otherwise("kept")
    )
    return full.withColumn("reason", reason).drop("known")


def build(citations: DataFrame, paragraphs: DataFrame, meta: DataFrame) -> DataFrame:
    """The pair table: titles and dates of both cases, numbered texts; undated
    pairs and those that cite the future go, one of equal pairs stays.

    ``meta``: celex, title, date, unique by celex; an unknown title is empty.
    """
    kept = considered(citations, paragraphs).where("reason = 'kept'").drop("reason")
    side = lambda end: meta.select(F.col("celex").alias(f"celex_{end}"), F.coalesce("title", F.lit("")).alias(f"title_{end}"), F.col("date").alias(f"date_{end}"))
    dated = kept.dropDuplicates(list(KEY)).join(side("from"), "celex_from").join(side("to"), "celex_to").where("date_from >= date_to")
    return dated.withColumns({f"text_{end}": numbered(F.col(f"number_{end}"), F.col(f"text_{end}")) for end in ("from", "to")})


def first_text(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """One text a key: that of the first row."""
    return rows.groupBy(*keys).agg(F.min_by(text, order).alias(text))


def override(paragraphs: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs with the other text where there is one (``text`` in both)."""
    other = texts.select(*keys, F.col("text").alias("__other"))
    return paragraphs.join(other, keys, "left").withColumn("text", F.coalesce("__other", "text")).drop("__other")


def shared(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the fields in which both sides have a value in common; null
    fields and null values share nothing."""
    hits = [F.when(F.coalesce(F.arrays_overlap(F.array_compact(a[name]), F.array_compact(b[name])), F.lit(False)), F.lit(name)) for name in a]
    return F.array_compact(F.array(*hits))


def as_set(value: Column, kind: str) -> Column:
    """Sorted distinct values of a scalar, an array, or a map's keys; null is
    empty, nulls inside go."""
    listed = {"scalar": lambda: F.array(value), "array": lambda: value, "map": lambda: F.map_keys(value)}[kind]()
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(listed))), F.array().cast("array<string>"))


def in_any(number: Column, ranges: Column) -> Column:
    """Is the number inside one of the (start, end) ranges?  Equal ranges count
    once; null or no ranges: no."""
    return F.coalesce(F.exists(F.array_distinct(ranges), lambda r: number.between(r["start"], r["end"])), F.lit(False))


def relative_number(df: DataFrame, case: str, number: str) -> DataFrame:
    """``position``: the number over the case's greatest one."""
    most = df.groupBy(case).agg(F.max(number).alias("__most"))
    return df.join(most, case).withColumn("position", F.try_divide(F.col(number), F.col("__most"))).drop("__most")


def remap(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """Pairs of global ids (src, dst) as local ids of a sample (node, local);
    both ends must be in it."""
    end = lambda name: sample.select(F.col("node").alias(name), F.col("local").alias(f"{name}_local"))
    return pairs.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_local").alias("src"), F.col("dst_local").alias("dst"))


def inventory(pairs: DataFrame, *by: str) -> DataFrame:
    """Rows in chronological groups: group number, size; a group is one date."""
    groups = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    return groups.withColumn("group", F.row_number().over(W.orderBy(*by)) - 1)
