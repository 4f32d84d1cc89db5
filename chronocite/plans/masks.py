"""Training masks, leakage checks and typed edge builders over parts: a part is
a paragraph, its brand the case, its size the age, and the smaller half of the
sizes is in training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .lenses import EDGES, edges, table
from .registry import query

ANCHORS = "SELECT p_partkey AS node FROM part WHERE p_partkey % 20 = 0 AND p_size <= 25"


def nodes(spark, sf, where="true"):
    return table(spark, sf, "part").where(where).select(F.col("p_partkey").alias("node"))


def anchors(spark, sf):
    return nodes(spark, sf, "p_partkey % 20 = 0 and p_size <= 25")


def train(spark, sf):
    return nodes(spark, sf, "p_size <= 25")


@query(f"WITH e AS ({EDGES}) SELECT p_partkey AS node FROM part WHERE p_partkey IN (SELECT src FROM e) AND (p_size % 10 = 0 OR 1970 + p_size < 2000)")
def citing_before_cutoff(spark, sf):
    """Citing paragraphs of before the cutoff year; an unknown year stays."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") % 10 != 0, 1970 + F.col("p_size")).alias("year"))
    return p.join(edges(spark, sf), "src", "left_semi").where("year is null or year < 2000").select(F.col("src").alias("node"))


@query(f"SELECT src, dst FROM ({EDGES}) WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def train_edges(spark, sf):
    return G.check_train_only(G.train_edges(edges(spark, sf), train(spark, sf)), train(spark, sf)).select("src", "dst")


@query(f"SELECT src, dst FROM ({EDGES}) WHERE src NOT IN ({ANCHORS})")
def mask_semantic(spark, sf):
    return G.mask_out(edges(spark, sf), anchors(spark, sf)).select("src", "dst")


@query(f"WITH h AS (SELECT p_partkey AS node FROM part WHERE p_brand || (p_partkey % 40) IN (SELECT p_brand || (p_partkey % 40) FROM part WHERE p_partkey IN ({ANCHORS}))) SELECT src, dst FROM ({EDGES}) WHERE src NOT IN (SELECT node FROM h) AND dst NOT IN (SELECT node FROM h)")
def mask_heterogeneous(spark, sf):
    """No citation touches any paragraph of the anchors' cases."""
    members = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.concat("p_brand", F.col("p_partkey") % 40).alias("case"))
    return G.mask_cases(edges(spark, sf), anchors(spark, sf), members).select("src", "dst")


@query(f"SELECT src, dst FROM ({EDGES}) WHERE NOT (src IN ({ANCHORS}) AND dst NOT IN ({ANCHORS}))")
def mask_evaluation(spark, sf):
    return G.mask_leaving(edges(spark, sf), anchors(spark, sf)).select("src", "dst")


@query(f"WITH e AS ({EDGES}) SELECT src, dst, 0 AS type FROM e UNION ALL SELECT dst, src, 1 FROM e UNION ALL SELECT p_partkey, p_partkey, 2 FROM part")
def homogeneous_graph(spark, sf):
    return G.homogeneous(edges(spark, sf), nodes(spark, sf))


SIMILAR = "SELECT p_partkey AS src, p_partkey - 1 AS dst FROM part WHERE p_partkey % 4 = 0"
REFERENCES = "SELECT p_partkey AS src, -1 - p_size AS dst FROM part"
ARTICLES = "SELECT DISTINCT -1 - p_size AS src, -2 - p_size AS dst FROM part"


@query(f"WITH s AS ({SIMILAR}), r AS ({REFERENCES}), a AS ({ARTICLES}) SELECT src, dst, 0 AS type FROM s UNION ALL SELECT dst, src, 0 FROM s UNION ALL SELECT src, dst, 1 FROM r UNION ALL SELECT dst, src, 2 FROM r UNION ALL SELECT src, dst, 3 FROM a UNION ALL SELECT dst, src, 3 FROM a")
def semantic_graph(spark, sf):
    """Articles are the sizes, by negative ids."""
    p = table(spark, sf, "part")
    article = (-1 - F.col("p_size")).cast("long")
    similar = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst"))
    return G.semantic(similar, p.select(F.col("p_partkey").alias("src"), article.alias("dst")), p.select(article.alias("src"), (article - 1).alias("dst")).distinct())


@query(f"SELECT DISTINCT src AS node FROM ({EDGES}) WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def nodes_with_positives(spark, sf):
    return G.train_edges(edges(spark, sf), train(spark, sf)).select(F.col("src").alias("node")).distinct()


@query(f"WITH e AS ({EDGES}) SELECT p_partkey AS node, p_partkey IN (SELECT src FROM e UNION SELECT dst FROM e) AS linked FROM part")
def citation_node_mask(spark, sf):
    return nodes(spark, sf).join(G.ends(edges(spark, sf)).withColumn("l", F.lit(True)), "node", "left").select("node", F.col("l").isNotNull().alias("linked"))


@query(f"WITH RECURSIVE o AS ({EDGES}), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o WHERE src % 50 = 0), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = node), node)) AS component FROM n")
def strong_components(spark, sf):
    """Some links are given a way back, as the tables have no cycle."""
    e = edges(spark, sf).select("src", "dst")
    back = e.where("src % 50 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.strong_components(e.unionByName(back).distinct())


@query("SELECT conv_id, min(turn) AS first, count(*) AS n FROM conversations GROUP BY 1")
def case_spans(spark, sf):
    """Least time and number of paragraphs of each case."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n"))
