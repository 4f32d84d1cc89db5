"""Pair building and lookups, with conversations as cases and turns as paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from .lenses import table
from .registry import query

DATE = "CAST(DATE '2000-01-01' + CAST({0} * 37 % 5000 AS INTEGER) AS DATE)"
# Each case cites its half, its predecessor, sometimes itself or a case that isn't there.
REFS = """c AS (SELECT DISTINCT conv_id AS id FROM conversations), r AS (
SELECT id, id // 2 AS target, [1, 2] AS f, [1, 3] AS t FROM c UNION ALL SELECT id, id - 1, [2, 9], [2] FROM c WHERE id > 0
UNION ALL SELECT id, id // 2, [1], [1] FROM c WHERE id % 5 = 0 UNION ALL SELECT id, id + 9000000, [1], [1] FROM c WHERE id % 7 = 0),
x AS (SELECT id, target, unnest(f) AS fn, t FROM r), y AS (SELECT id, target, fn, unnest(t) AS tn FROM x),
z AS (SELECT y.*, CASE WHEN id = target THEN 'dropped_self' WHEN a.conv_id IS NULL THEN 'from_missing' WHEN target NOT IN (SELECT id FROM c) THEN 'target_case_missing' WHEN b.conv_id IS NULL THEN 'target_paragraph_missing' ELSE 'kept' END AS reason, a.text AS text_from, b.text AS text_to
FROM y LEFT JOIN conversations a ON a.conv_id = id AND a.turn = fn LEFT JOIN conversations b ON b.conv_id = target AND b.turn = tn)"""


def cases(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()


def paragraphs(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("celex"), F.col("turn").cast("int").alias("number"), "text")


def references(spark, sf):
    """Citations by case key; the key stands for the identifier, as units do."""
    ref = lambda where, target, f, t: cases(spark, sf).where(where).select(F.col("id").alias("celex_from"), F.expr(target).cast("long").alias("t"), F.array(*map(F.lit, f)).alias("from"), F.array(*map(F.lit, t)).alias("to"))
    found = ref("true", "floor(id / 2)", (1, 2), (1, 3)).unionByName(ref("id > 0", "id - 1", (2, 9), (2,))).unionByName(ref("id % 5 = 0", "floor(id / 2)", (1,), (1,))).unionByName(ref("id % 7 = 0", "id + 9000000", (1,), (1,)))
    named = found.withColumns({"celex_from": F.concat(F.lit("6CJ"), F.col("celex_from")), "target": F.concat(F.lit("6CJ"), F.col("t")), "unit": F.lit("paragraphs"), "cited_unit": F.lit("paragraphs")})
    return named.drop("t")


def named_paragraphs(spark, sf):
    return paragraphs(spark, sf).withColumn("celex", F.concat(F.lit("6CJ"), F.col("celex")))


@query(f"WITH {REFS} SELECT reason, count(*) AS n FROM z GROUP BY 1")
def pair_drop_reasons(spark, sf):
    return P.considered(references(spark, sf), named_paragraphs(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


NUMBERED = "trim(CAST({n} AS VARCHAR) || ' ' || CASE WHEN regexp_extract(trim({t}), '^([0-9]+)', 1) = CAST({n} AS VARCHAR) THEN regexp_replace(trim({t}), '^[0-9]+[. \\t\\r\\n]*', '') ELSE trim({t}) END)"


@query(f"WITH {REFS} SELECT DISTINCT '6CJ' || id AS celex_from, CAST(fn AS INTEGER) AS number_from, '6CJ' || target AS celex_to, CAST(tn AS INTEGER) AS number_to, 'case ' || id AS title_from, 'case ' || target AS title_to, {DATE.format('id')} AS date_from, {DATE.format('target')} AS date_to, md5({NUMBERED.format(n='fn', t='text_from')}) AS text_from, md5({NUMBERED.format(n='tn', t='text_to')}) AS text_to FROM z WHERE reason = 'kept' AND {DATE.format('id')} >= {DATE.format('target')}")
def pair_build(spark, sf):
    """Pairs with titles, dates and numbered texts, of whole conversations."""
    date = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 37 % 5000).cast("int"))
    meta = cases(spark, sf).select(F.concat(F.lit("6CJ"), F.col("id")).alias("celex"), F.concat(F.lit("case "), F.col("id")).alias("title"), date.alias("date"))
    built = P.build(references(spark, sf), named_paragraphs(spark, sf), meta)
    return built.withColumns({c: F.md5(c) for c in ("text_from", "text_to")}).select("celex_from", "number_from", "celex_to", "number_to", "title_from", "title_to", "date_from", "date_to", "text_from", "text_to")


@query("WITH m AS (SELECT user_id AS id, arg_min(event_type, event_id) AS t FROM events GROUP BY 1) SELECT conv_id, turn, coalesce(t, md5(text)) AS text FROM conversations LEFT JOIN m ON conv_id = id")
def text_override(spark, sf):
    """A case's paragraphs take the first masked text, where there is one."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("text"), "event_id")
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("text"))
    return P.override(own, P.first_text(e, ["conv_id"], "text", "event_id"), ["conv_id"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def citing_semi(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality IS NULL THEN '' ELSE 'labelled' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_lookup(spark, sf):
    """Left lookup, defaults where there is none."""
    found = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("quality").isNull(), "").otherwise("labelled").alias("state"))


@query("SELECT p_partkey, CASE WHEN p_brand = s.brand AND p_size % 5 = s.size % 5 THEN 'brand,size' WHEN p_brand = s.brand THEN 'brand' WHEN p_size % 5 = s.size % 5 THEN 'size' ELSE '' END AS shared FROM part p JOIN (SELECT p_partkey + 1 AS k, p_brand AS brand, p_size AS size FROM part) s ON s.k = p_partkey")
def share_metadata(spark, sf):
    """Fields that a part shares with the one before it, scalars or lists."""
    p = table(spark, sf, "part").select("p_partkey", F.array("p_brand").alias("brand"), F.array(F.col("p_size") % 5, F.lit(None).cast("int")).alias("size"))
    before = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("brand").alias("b"), F.col("size").alias("s"))
    return p.join(before, "p_partkey").select("p_partkey", F.array_join(P.shared({"brand": F.col("brand"), "size": F.col("size")}, {"brand": F.col("b"), "size": F.col("s")}), ",").alias("shared"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber BETWEEN l_orderkey % 5 AND l_orderkey % 5 + 1 OR l_linenumber BETWEEN 6 AND 6 + l_partkey % 2 AS inside FROM lineitem")
def number_in_ranges(spark, sf):
    """Equal ranges collapse, then one that holds the number is enough."""
    r = lambda a, b: F.struct(F.expr(a).cast("int").alias("start"), F.expr(b).cast("int").alias("end"))
    one = r("l_orderkey % 5", "l_orderkey % 5 + 1")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.in_any(F.col("l_linenumber"), F.array(one, r("6", "6 + l_partkey % 2"), one)).alias("inside"))


@query("SELECT conv_id, turn, round(turn / max(turn) OVER (PARTITION BY conv_id), 9) AS position FROM conversations")
def relative_number(spark, sf):
    """A case whose only number is 0 has no position."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return P.relative_number(c, "conv_id", "turn").select("conv_id", "turn", F.round("position", 9).alias("position"))


@query("WITH q AS (SELECT doc_id, n_chars % 1000 / 1000.0 AS share FROM documents WHERE lang <> 'de'), b AS (SELECT l.doc_id, l.quality, q.share FROM labels l LEFT JOIN q USING (doc_id)), e AS (SELECT unnest(range(0, 10)) AS k) SELECT CAST(k * 10 AS VARCHAR) || '-' || CAST(k * 10 + 10 AS VARCHAR) || '%' AS bin, count(doc_id) AS n, round(coalesce(avg(quality), 0), 9) AS mean FROM e LEFT JOIN b ON CAST(floor(share * 10) AS BIGINT) = k GROUP BY k UNION ALL SELECT 'unmatched', count(*), round(coalesce(avg(quality), 0), 9) FROM b WHERE share IS NULL")
def difficulty_of_queries(spark, sf):
    """Results looked up by their query's share; empty bins give zeros, results
    without a share are counted apart."""
    share = table(spark, sf, "documents").where("lang != 'de'").select("doc_id", (F.col("n_chars") % 1000 / 1000).alias("share"))
    found = table(spark, sf, "labels").select("doc_id", "quality").join(share, "doc_id", "left")
    name = lambda k: F.concat((k * 10).cast("string"), F.lit("-"), (k * 10 + 10).cast("string"), F.lit("%"))
    at = F.coalesce(name(F.floor(F.col("share") * 10)), F.lit("unmatched"))
    counted = found.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean"))
    bins = spark.range(10).select(name(F.col("id")).alias("bin")).unionByName(spark.range(1).select(F.lit("unmatched").alias("bin")))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("mean"))


@query("SELECT a.lang, a.n AS documents, a.mean AS mean_chars, b.good FROM (SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1) a JOIN (SELECT lang, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1) b USING (lang)")
def summary_merge(spark, sf):
    """Two summaries by language, renamed and merged on it."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    size = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    good = d.join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"))
    return size.withColumnsRenamed({"n": "documents", "mean": "mean_chars"}).join(good, "lang")


@query("SELECT o_orderkey, n_regionkey = 1 AS r1, coalesce(n_regionkey, 0) = 0 AS r0 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def parent_features(spark, sf):
    """A child takes its parent's feature vector, zeros where there is none."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(n, "c_nationkey", "left").select("o_custkey", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == F.col("r")).cast("float")).alias("vec"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), 5)))
    return o.select("o_orderkey", (F.col("vec")[1] == 1).alias("r1"), (F.col("vec")[0] == 1).alias("r0"))


@query("WITH s AS (SELECT p_partkey AS node, row_number() OVER (ORDER BY p_partkey) - 1 AS local FROM part WHERE p_size > 25), e AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part) WHERE dst > 0 AND dst <> src) SELECT a.local AS src, b.local AS dst FROM e JOIN s a ON e.src = a.node JOIN s b ON e.dst = b.node")
def subgraph_remap(spark, sf):
    from .curation import dense_id
    from .lenses import edges

    local = dense_id(table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("node")), "node", name="local")
    return P.remap(edges(spark, sf), local)


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS \"group\" FROM orders GROUP BY 1")
def time_groups(spark, sf):
    """Days in order: the groups are numbered, of which there are few."""
    return P.inventory(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day")
