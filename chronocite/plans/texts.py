"""Text operators: cleaning, lengths, language votes, verbatim passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import vectors as V
from ..operators import verbatim
from .lenses import table
from .registry import query


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def normalize_whitespace(spark, sf):
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n"))


@query()
def clean_text(spark, sf):
    t = C.clean(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


@query()
def mask_dates(spark, sf):
    """Turns of conversations with dates and an official-journal reference added."""
    t = C.without_dates(F.concat(F.col("text"), F.lit(" On 12 May 2004 and 2004-05-12 (OJ 2004 L 1).")))
    return table(spark, sf, "conversations").select("conv_id", "turn", t.alias("masked"))


@query()
def number_ranges_in_text(spark, sf):
    t = F.concat_ws(" ", F.col("text"), F.lit("paragraphs 47 to 50 and 53-55"))
    return table(spark, sf, "documents").select("doc_id", F.explode(C.number_ranges(t)).alias("r")).select("doc_id", "r.start", "r.end")


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most, round(median(n_chars), 6) AS middle FROM documents GROUP BY 1")
def text_length_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev("n_chars"), 6).alias("std"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.percentile("n_chars", 0.5), 6).alias("middle"))


@query("WITH t AS (SELECT DISTINCT text FROM documents UNION SELECT DISTINCT text FROM benchmark) SELECT count(*) AS n, round(quantile_cont(length(text), 0.1), 6) AS p10, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.99), 6) AS p99, round(avg(len(string_split_regex(trim(text), '\\s+'))), 6) AS words FROM t")
def text_percentiles(spark, sf):
    """Lengths of the distinct texts of both sides."""
    t = table(spark, sf, "documents").select("text").union(table(spark, sf, "benchmark").select("text")).distinct()
    n = t.select(F.length("text").alias("n"), F.size(F.split(F.trim("text"), r"\s+")).alias("w"))
    return n.agg(F.count("*").alias("n"), *[F.round(F.percentile("n", p), 6).alias(a) for a, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99))], F.round(F.avg("w"), 6).alias("words"))


VOCABULARY = ["de", "en", "es", "fr"]


@query("SELECT doc_id, pos, CASE WHEN lang = (['de', 'en', 'es', 'fr'])[pos + 1] THEN 1.0 ELSE 0.0 END AS value FROM documents, (SELECT unnest([0, 1, 2, 3]) AS pos)")
def language_multihot(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(V.multihot(F.array("lang"), VOCABULARY)).alias("pos", "value")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query("WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE n_chars >= 20 GROUP BY 1, 2), t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1) SELECT source, lang, n, round(n / total, 6) AS confidence FROM n JOIN t USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1")
def language_vote(spark, sf):
    """Majority language of a source; texts that are too short count only in
    the total; ties go to the language seen first."""
    d = table(spark, sf, "documents").select("source", "lang", "n_chars", "doc_id")
    n = d.groupBy("source", "lang").agg(F.count_if(F.col("n_chars") >= 20).alias("n"), F.min(F.when(F.col("n_chars") >= 20, F.col("doc_id"))).alias("first"), F.count("*").alias("all"))
    w = W.partitionBy("source")
    return n.withColumn("total", F.sum("all").over(w)).where("n > 0").withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first"))).where("r = 1").select("source", "lang", "n", F.round(F.col("n") / F.col("total"), 6).alias("confidence"))


# Frequent words of each language.
PROFILES = {"en": ("the", "of", "and", "to", "in", "that", "is", "with"), "fr": ("le", "la", "des", "et", "un", "que", "au", "en"), "de": ("der", "die", "und", "das", "ein", "von", "mit", "ist"), "es": ("el", "los", "que", "y", "un", "del", "con", "para")}


@query()
def detect_language(spark, sf):
    """The language whose frequent words cover most of a text; ties by name."""
    words = F.split(C.language_text(F.col("text")), " ")
    score = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    best = F.array_max(F.array(*[F.struct(score(ws).alias("n"), F.lit(lang).alias("lang")) for lang, ws in PROFILES.items()]))
    return table(spark, sf, "documents").select("doc_id", F.when(C.language_text(F.col("text")).isNotNull() & (best["n"] > 0), best["lang"]).alias("detected"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def verbatim_contains(spark, sf):
    """Whole benchmark items inside documents: the item's first three words
    are the join key, and only documents that have them are searched."""
    key = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    flat = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))
    # an item may begin inside a word, so its second to fourth words are whole
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"), flat(F.col("text")).alias("w")).select("item_id", "item", F.when(F.size("w") >= 5, key(F.col("w"), F.lit(1))).alias("k"))
    docs = table(spark, sf, "documents").select("doc_id", "text", flat(F.col("text")).alias("w"))
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2))))).alias("k"))
    met = keys.join(F.broadcast(items.where("k is not null")), "k").select("doc_id", "item_id", "item")
    long = met.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("doc_id", "item_id")
    short = items.where("k is null")
    if short.limit(1).count():
        long = long.unionByName(docs.join(F.broadcast(short), F.contains("text", "item")).select("doc_id", "item_id"))
    return long


def passages(spark, sf):
    """Documents against the benchmark items that share three words with them."""
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    held = spark.sparkContext.broadcast(items)

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        index: dict[tuple[str, ...], set[int]] = {}
        for k, (_, t) in enumerate(held.value):
            w = (t or "").split()
            for j in range(len(w) - 2):
                index.setdefault(tuple(w[j : j + 3]), set()).add(k)
        out = []
        for t in texts:
            w = (t or "").split()
            near = set().union(*(index.get(tuple(w[j : j + 3]), ()) for j in range(len(w) - 2)))
            spans = verbatim.merged([s for k in near for s in verbatim.spans(t, held.value[k][1])])
            out.append([{"begin": s, "end": e} for s, e in spans])
        return pd.Series(out, dtype=object)

    return table(spark, sf, "documents").select("doc_id", "text", found("text").alias("spans"))


@query()
def verbatim_pct(spark, sf):
    covered = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["begin"])
    return passages(spark, sf).select("doc_id", F.round(F.coalesce(F.try_divide(covered, F.length("text")), F.lit(0.0)), 6).alias("pct"))


@query()
def verbatim_mask(spark, sf):
    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([verbatim.masked(t, [(s["begin"], s["end"]) for s in x]) for t, x in zip(texts, spans, strict=True)])

    return passages(spark, sf).where(F.size("spans") > 0).select("doc_id", masked("text", "spans").alias("masked"))


@query("WITH x AS (SELECT doc_id, (doc_id % 101) / 100.0 AS pct, n_chars FROM documents), b AS (SELECT least(CAST(floor(pct * 10) AS BIGINT), 9) AS bin, n_chars FROM x) SELECT bin, count(n_chars) AS n, round(coalesce(avg(n_chars), 0), 6) AS mean FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN b USING (bin) GROUP BY 1")
def difficulty_bins(spark, sf):
    """Ten bins of a share; the last takes 1.0; an empty bin has zeros."""
    pct = (F.col("doc_id") % 101) / 100
    b = table(spark, sf, "documents").select(F.least(F.floor(F.round(pct * 10, 9)), F.lit(9)).alias("bin"), "n_chars")
    return spark.range(10).withColumnRenamed("id", "bin").join(b, "bin", "left").groupBy("bin").agg(F.count("n_chars").alias("n"), F.round(F.coalesce(F.avg("n_chars"), F.lit(0.0)), 6).alias("mean"))
