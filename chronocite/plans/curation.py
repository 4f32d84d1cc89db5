"""Pair curation: null, self and temporal filters, dedup, unions, splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from .lenses import PAIRS, pairs, table
from .registry import query

ALL = ("from_id", "from_no", "date_from", "to_id", "to_no", "date_to")
DAYS = "CAST(date_diff('day', {}, {}) AS BIGINT)"


def cleaned(p):
    """No null, no self-citation, nothing that cites the future."""
    return p.na.drop("any").where("from_id != to_id and date_from >= date_to")


@query(f"SELECT count(*) AS n, CAST(sum(from_id) AS BIGINT) AS ids, CAST(sum(to_no) AS BIGINT) AS nos FROM ({PAIRS}) WHERE from_id <> to_id AND date_from >= date_to")
def pair_clean(spark, sf):
    return cleaned(pairs(spark, sf)).agg(F.count("*").alias("n"), F.sum("from_id").alias("ids"), F.sum("to_no").alias("nos"))


@query(f"SELECT from_id, from_no, date_from, to_id, to_no, date_to FROM (SELECT *, row_number() OVER (PARTITION BY from_id, from_no ORDER BY date_from, to_id, to_no, date_to) AS r FROM ({PAIRS}) WHERE from_id <> to_id AND date_from >= date_to) WHERE r = 1")
def pair_dedup(spark, sf):
    first = W.partitionBy("from_id", "from_no").orderBy("date_from", "to_id", "to_no", "date_to")
    return cleaned(pairs(spark, sf)).withColumn("r", F.row_number().over(first)).where("r = 1").select(*ALL)


@query(f"SELECT from_id, from_no, to_id, to_no, source FROM (SELECT *, row_number() OVER (PARTITION BY from_id, from_no, to_id, to_no ORDER BY source, date_from, date_to) AS r FROM (SELECT *, 0 AS source FROM ({PAIRS}) WHERE from_id % 3 <> 0 UNION ALL SELECT *, 1 FROM ({PAIRS}) WHERE from_id % 3 <> 1)) WHERE r = 1")
def pair_union_merge(spark, sf):
    """Old and new pairs by name; of equal ones the old stays."""
    p = pairs(spark, sf)
    both = p.where("from_id % 3 != 0").withColumn("source", F.lit(0)).unionByName(p.where("from_id % 3 != 1").withColumn("source", F.lit(1)))
    first = W.partitionBy("from_id", "from_no", "to_id", "to_no").orderBy("source", "date_from", "date_to")
    return both.withColumn("r", F.row_number().over(first)).where("r = 1").select("from_id", "from_no", "to_id", "to_no", "source")


@query(f"WITH p AS ({PAIRS}), u AS (SELECT from_id AS id, from_no AS no, date_from AS date, 0 AS pass FROM p UNION ALL SELECT to_id, to_no, date_to, 1 FROM p) SELECT id, no, min(date) AS date, min(pass) AS pass, CAST(dense_rank() OVER (ORDER BY id, no) - 1 AS BIGINT) AS pid FROM u GROUP BY id, no")
def paragraph_index(spark, sf):
    """One row a paragraph: least date, first pass, dense id in key order.

    The dense id is the number of keys in earlier ranges plus the row number in
    its own, so that no task sees all keys.
    """
    p = pairs(spark, sf)
    both = p.select(F.col("from_id").alias("id"), F.col("from_no").cast("long").alias("no"), F.col("date_from").alias("date"), F.lit(0).alias("pass")).unionByName(p.select(F.col("to_id").alias("id"), F.col("to_no").alias("no"), F.col("date_to").alias("date"), F.lit(1).alias("pass")))
    keys = both.groupBy("id", "no").agg(F.min("date").alias("date"), F.min("pass").alias("pass"))
    return dense_id(keys, "id", "no", name="pid")


def dense_id(rows, *order: str, name: str, slices: int = 256):
    """0-based row number in the order of unique keys, by value slices."""
    top = rows.agg(F.max(order[0]).alias("top"))
    marked = rows.join(F.broadcast(top), F.lit(True)).withColumn("slice", F.floor(F.col(order[0]) * slices / (F.col("top") + 1)))
    sizes = marked.groupBy("slice").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("slice").orderBy(*order)) - 1
    return marked.withColumn("inside", inside).join(F.broadcast(sizes), "slice").withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("slice", "top", "c", "before", "inside")


@query(f"SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS edges, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT from_id, count(DISTINCT to_id) AS n FROM ({PAIRS}) GROUP BY 1)")
def citation_adjacency_stats(spark, sf):
    lists = pairs(spark, sf).groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("to"))
    n = F.size("to").cast("long")
    return lists.agg(F.count("*").alias("sources"), F.sum(n).alias("edges"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


@query("SELECT year(o_orderdate) AS year, CASE WHEN year(o_orderdate) < 1996 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL")
def train_test_split_counts(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(y.cast("long").alias("year"), F.when(y < 1996, "train").otherwise("test").alias("split")).groupBy("year", "split").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (date_from < DATE '1996-01-01') AS train, count(*) FILTER (NOT date_from < DATE '1996-01-01') AS val, count(*) FILTER (date_from < date_to) AS pre FROM ({PAIRS})")
def train_val_split_counts(spark, sf):
    return pairs(spark, sf).agg(F.count_if(F.col("date_from") < F.make_date(F.lit(1996), F.lit(1), F.lit(1))).alias("train"), F.count_if(~(F.col("date_from") < F.make_date(F.lit(1996), F.lit(1), F.lit(1)))).alias("val"), F.count_if(F.coalesce(F.col("date_from") < F.col("date_to"), F.lit(False))).alias("pre"))


@query(f"SELECT count(*) AS edges, count(DISTINCT from_id) AS cases_from, count(DISTINCT to_id) AS cases_to, count(DISTINCT (from_id, from_no, to_id, to_no)) AS pairs, count(*) - count(DISTINCT (from_id, from_no, to_id, to_no)) AS repeats, count(*) FILTER (from_id = to_id) AS self, count(*) FILTER (date_from > date_to) AS later, count(*) FILTER (date_from < date_to) AS violating, count(*) FILTER (date_from = date_to) AS same_day FROM ({PAIRS})")
def basic_edge_stats(spark, sf):
    distinct = F.count_distinct("from_id", "from_no", "to_id", "to_no")
    return pairs(spark, sf).agg(
        F.count("*").alias("edges"), F.count_distinct("from_id").alias("cases_from"), F.count_distinct("to_id").alias("cases_to"), distinct.alias("pairs"), (F.count("*") - distinct).alias("repeats"),
        F.count_if(F.expr("from_id = to_id")).alias("self"), F.count_if(F.expr("date_from > date_to")).alias("later"), F.count_if(F.expr("date_from < date_to")).alias("violating"), F.count_if(F.expr("date_from = date_to")).alias("same_day"),
    )


@query("WITH c AS (SELECT DISTINCT year(o_orderdate) AS year, 2 * o_custkey AS id FROM orders) SELECT year, count(*) AS n, count(*) FILTER (id % 3 = 0) AS subset FROM c WHERE id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def missing_ids_by_year(spark, sf):
    """Cited ids that no document has, by year of citation, all and of a subset.

    The tables cite only what they have; twice a customer's key is cited instead.
    """
    cited = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("year"), (2 * F.col("o_custkey")).alias("id")).distinct()
    missing = cited.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", "left_anti")
    return missing.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("subset"))


AGREE = "WITH a AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS t, l_linenumber AS p FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS t, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS p FROM lineitem WHERE l_linenumber >= 2)"


@query(AGREE + ", k AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.f = a.f AND b.t = a.t AND b.p = a.p) THEN 'exact' WHEN EXISTS (SELECT 1 FROM b WHERE b.f = a.f AND b.t = a.t AND b.p IS NULL) THEN 'partial' ELSE 'none' END AS kind FROM a) SELECT kind, count(*) AS n FROM k GROUP BY 1")
def agreement_bidirectional(spark, sf):
    """Two routes of extraction: exact match, else one without a paragraph."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("t"), F.col("l_linenumber").alias("p"))
    a, b = li.where("p <= 4").distinct(), li.where("p >= 2").withColumn("p", F.when(F.col("p") % 3 != 0, F.col("p"))).distinct()
    exact, partial = b.where("p is not null").withColumn("e", F.lit(1)), b.where("p is null").select("f", "t", F.lit(1).alias("h"))
    kind = F.when(F.col("e") == 1, "exact").when(F.col("h") == 1, "partial").otherwise("none")
    return a.join(exact, ["f", "t", "p"], "left").join(partial, ["f", "t"], "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'C-' || CAST(o_orderkey % 10000 AS VARCHAR) || '/' || lpad(CAST(o_orderkey % 60 + 40 AS VARCHAR), 2, '0') AS case_id, '6' || CASE WHEN o_orderkey % 60 + 40 > 50 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 60 + 40 AS VARCHAR), 2, '0') || 'CJ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS celex, 'C-' || CAST(o_orderkey % 10000 AS VARCHAR) || '/' || lpad(CAST(o_orderkey % 60 + 40 AS VARCHAR), 2, '0') AS back, true AS allowed FROM orders")
def celex_codec(spark, sf):
    case = F.concat(F.lit("C-"), (F.col("o_orderkey") % 10000).cast("string"), F.lit("/"), F.lpad((F.col("o_orderkey") % 60 + 40).cast("string"), 2, "0"))
    made = table(spark, sf, "orders").select("o_orderkey", case.alias("case_id")).withColumn("celex", ids.case_to_celex(F.col("case_id")))
    return made.select("o_orderkey", "case_id", "celex", ids.celex_to_case(F.col("celex")).alias("back"), ids.allowed_type(F.col("celex")).alias("allowed"))


@query("SELECT DISTINCT * FROM (SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, l_linenumber + l_orderkey % 3 + 1)) AS paragraph, 'paragraphs' AS unit FROM lineitem)")
def range_expand(spark, sf):
    """The ranges of every line item."""
    end = F.col("l_linenumber") + F.col("l_orderkey") % 3
    text = F.concat(F.lit("N"), F.col("l_linenumber").cast("string"), F.lit(" - "), end.cast("string"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.explode(ids.expand_range(F.col("t"))).alias("p"), ids.unit(F.col("t")).alias("unit")).select("l_orderkey", "l_linenumber", F.col("p").cast("long").alias("paragraph"), "unit").distinct()


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id) AS r FROM documents) WHERE r <= 50")
def stratified_sample(spark, sf):
    """At most 50 rows a group, by a seeded hash: a sampling operator."""
    w = W.partitionBy("lang").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42"))), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "source").withColumn("r", F.row_number().over(w)).where("r <= 50").drop("r")
