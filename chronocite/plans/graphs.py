"""Citation graphs: builders, checks, degrees, components, paths, expansion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph as G
from .lenses import EDGES, PAIRS, edges, pairs, table
from .registry import query

DEG = f"WITH e AS ({EDGES}), d AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)"


@query(f"SELECT from_id, from_no, to_id, to_no FROM ({PAIRS}) WHERE date_from >= date_to")
def temporal_dag_edges(spark, sf):
    return pairs(spark, sf).where("date_from >= date_to").select("from_id", "from_no", "to_id", "to_no")


@query(f"SELECT count(*) AS n, CAST(sum(from_id) AS BIGINT) AS ids FROM ({PAIRS}) WHERE date_from >= date_to AND date_from < DATE '1996-06-01' AND date_to < DATE '1996-06-01'")
def temporal_subgraph(spark, sf):
    """Both ends are older than the query's date."""
    return pairs(spark, sf).where("date_from >= date_to and date_from < date'1996-06-01' and date_to < date'1996-06-01'").agg(F.count("*").alias("n"), F.sum("from_id").alias("ids"))


@query(f"WITH RECURSIVE o AS ({EDGES}), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o WHERE src % 50 = 0), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), c AS (SELECT DISTINCT a FROM r WHERE a = b), z AS (SELECT a FROM c UNION SELECT b FROM r JOIN c USING (a)) SELECT count(*) FILTER (date_from < date_to) AS violations, (SELECT count(*) FROM e WHERE src IN (SELECT a FROM z)) AS in_cycles FROM ({PAIRS})")
def dag_violations(spark, sf):
    """Violations of time, and links of or behind a cycle; some links are given a
    way back, as the tables have no cycle."""
    e = edges(spark, sf).select("src", "dst")
    back = e.where("src % 50 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    cycles = G.acyclic(e.unionByName(back).distinct()).count()
    return pairs(spark, sf).agg(F.count_if(F.expr("date_from < date_to")).alias("violations")).withColumn("in_cycles", F.lit(cycles))


@query(DEG + " SELECT count(*) AS nodes, max(out_degree) AS most_out, max(in_degree) AS most_in, round(avg(out_degree), 6) AS mean_out, round((SELECT count(*) FROM e) / (count(*) * (count(*) - 1)), 9) AS density, round(avg(ln(1 + out_degree + in_degree)), 6) AS log_degree FROM d")
def degree_stats(spark, sf):
    return G.degrees(edges(spark, sf)).agg(F.count("*").alias("nodes"), F.max("out_degree").alias("most_out"), F.max("in_degree").alias("most_in"), F.round(F.avg("out_degree"), 6).alias("mean_out"), F.round(F.sum("out_degree") / (F.count("*") * (F.count("*") - 1)), 9).alias("density"), F.round(F.avg(F.log1p(F.col("out_degree") + F.col("in_degree"))), 6).alias("log_degree"))


@query(f"WITH e AS ({EDGES}), f AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e WHERE dst % 5 = 0) SELECT count(*) AS edges, count(*) FILTER (EXISTS (SELECT 1 FROM f g WHERE g.src = f.dst AND g.dst = f.src)) AS mutual, round(count(*) FILTER (EXISTS (SELECT 1 FROM f g WHERE g.src = f.dst AND g.dst = f.src)) / count(*), 6) AS reciprocity FROM f")
def reciprocity(spark, sf):
    e = edges(spark, sf)
    f = e.unionByName(e.where("dst % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    back = f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    return f.join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.count("m").alias("mutual"), F.round(F.count("m") / F.count("*"), 6).alias("reciprocity"))


@query(DEG + " SELECT round(corr(a.out_degree + a.in_degree, b.out_degree + b.in_degree), 6) AS assortativity FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst")
def assortativity(spark, sf):
    e, d = edges(spark, sf), G.degrees(edges(spark, sf)).select("node", (F.col("out_degree") + F.col("in_degree")).cast("double").alias("d"))
    return e.join(d.select(F.col("node").alias("src"), F.col("d").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("b")), "dst").agg(F.round(F.corr("a", "b"), 6).alias("assortativity"))


RANKS = "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)" + "".join(f", r{k} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n) + 0.85 * coalesce(s.got, 0) AS rank FROM n LEFT JOIN (SELECT e.dst AS node, sum(r.rank / l.links) AS got FROM e JOIN l USING (src) JOIN r{k - 1} r ON r.node = e.src GROUP BY 1) s USING (node))" for k in range(1, 6))


@query(f"WITH e AS MATERIALIZED ({EDGES}), n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS MATERIALIZED (SELECT src, count(*) AS links FROM e GROUP BY 1), {RANKS.replace(' AS (SELECT n.node', ' AS MATERIALIZED (SELECT n.node')} SELECT node, round(rank, 9) AS rank FROM r5")
def pagerank_5(spark, sf):
    """Five rounds, which plain SQL can spell out."""
    return G.pagerank(edges(spark, sf), 5).select("node", F.round("rank", 9).alias("rank"))


@query()
def pagerank_20(spark, sf):
    return G.pagerank(edges(spark, sf), 20).select("node", F.round("rank", 9).alias("rank"))


COMPONENT_EDGES = "SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part WHERE (p_partkey % 10) < 6 AND p_partkey + 7 <= (SELECT max(p_partkey) FROM part)"


@query(f"WITH RECURSIVE e AS ({COMPONENT_EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS root FROM u UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1")
def weak_components(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    top = p.agg(F.max("src").alias("top"))
    e = p.where("src % 10 < 6").withColumn("dst", F.col("src") + 7).join(F.broadcast(top), F.expr("dst <= top")).drop("top")
    return G.weak_components(e)


@query(f"WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT src AS source, src AS node, 0 AS distance FROM e UNION SELECT r.source, u.dst, r.distance + 1 FROM r JOIN u ON u.src = r.node WHERE r.distance < 3) SELECT source, node, min(distance) AS distance FROM r GROUP BY 1, 2")
def bfs_distance(spark, sf):
    """Distances up to three hops on the undirected graph."""
    e = edges(spark, sf)
    return G.distances(G.undirected(e), e.select(F.col("src").alias("node")).distinct(), 3)


@query(f"WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT src AS source, src AS node, 0 AS distance FROM e UNION SELECT r.source, u.dst, r.distance + 1 FROM r JOIN u ON u.src = r.node WHERE r.distance < 3), d AS (SELECT source, node, min(distance) AS distance FROM r GROUP BY 1, 2) SELECT count(*) FILTER (distance = 0) AS hits, count(*) FILTER (distance > 0) AS near, round(avg(distance) FILTER (distance > 0), 6) AS mean, round(quantile_cont(distance, 0.9) FILTER (distance > 0), 6) AS p90 FROM d")
def distance_summary(spark, sf):
    """From the number of pairs at each distance."""
    d = bfs_distance(spark, sf).groupBy("distance").agg(F.count("*").alias("n"))
    far, n = F.when(F.col("distance") > 0, F.col("distance")), F.col("n")
    near = F.coalesce(F.sum(F.when(far.isNotNull(), n)), F.lit(0))
    return d.agg(F.coalesce(F.sum(F.when(F.col("distance") == 0, n)), F.lit(0)).alias("hits"), near.alias("near"), F.round(F.try_divide(F.sum(far * n), near), 6).alias("mean"), F.round(F.percentile(far, 0.9, n), 6).alias("p90"))


CANDIDATES = "SELECT DISTINCT src AS a, src + o AS b FROM e, (SELECT unnest([1, 2, 3, 5]) AS o)"


@query(f"WITH RECURSIVE e AS ({EDGES}), k AS ({CANDIDATES} UNION SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e), up AS (SELECT DISTINCT a AS s, a AS n, 0 AS h FROM k UNION SELECT up.s, e.dst, h + 1 FROM up JOIN e ON e.src = up.n WHERE h < 3), down AS (SELECT DISTINCT a AS s, a AS n, 0 AS h FROM k UNION SELECT down.s, e.src, h + 1 FROM down JOIN e ON e.dst = down.n WHERE h < 3) SELECT relation, count(*) AS n FROM (SELECT a, b, CASE WHEN a = b THEN 'exact' WHEN EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b) THEN 'parent' WHEN EXISTS (SELECT 1 FROM e WHERE src = b AND dst = a) THEN 'child' WHEN EXISTS (SELECT 1 FROM e x JOIN e y ON x.dst = y.dst WHERE x.src = a AND y.src = b) THEN 'sibling' WHEN EXISTS (SELECT 1 FROM up WHERE s = a AND n = b) THEN 'ancestor' WHEN EXISTS (SELECT 1 FROM down WHERE s = a AND n = b) THEN 'descendant' WHEN NOT EXISTS (SELECT 1 FROM e WHERE src = b OR dst = b) THEN 'not_in_graph' ELSE 'unrelated' END AS relation FROM k) GROUP BY 1")
def relationship_class(spark, sf):
    """The first that holds: exact, parent, child, sibling, ancestor and
    descendant within three hops, not in the graph, unrelated."""
    e = edges(spark, sf)
    k = e.select(F.col("src").alias("a"), F.explode(F.array(F.col("src"), F.col("dst"), *[F.col("src") + o for o in (1, 2, 3, 5)])).alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = k.select(F.col("a").alias("node")).distinct()
    flag = lambda df, a, b, name: df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(True).alias(name)).distinct()
    sibling = start.withColumnRenamed("node", "src").join(e, "src").select(F.col("src").alias("a"), "dst").join(e, "dst").select("a", F.col("src").alias("b"))
    found = k
    for df in (flag(e, "src", "dst", "parent"), flag(e, "dst", "src", "child"), flag(sibling, "a", "b", "sibling"), flag(G.distances(e, start, 3), "source", "node", "ancestor"), flag(G.distances(back, start, 3), "source", "node", "descendant")):
        found = found.join(df, ["a", "b"], "left")
    inside = e.select(F.col("src").alias("b")).union(e.select("dst")).distinct().withColumn("inside", F.lit(True))
    relation = F.when(F.expr("a = b"), "exact")
    for name in ("parent", "child", "sibling", "ancestor", "descendant"):
        relation = relation.when(F.col(name), name)
    relation = relation.when(F.col("inside").isNull(), "not_in_graph").otherwise("unrelated")
    return found.join(inside, "b", "left").groupBy(relation.alias("relation")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT src AS source, src AS node, 0 AS h FROM e UNION SELECT r.source, u.dst, h + 1 FROM r JOIN u ON u.src = r.node WHERE h < 2), d AS (SELECT source, node, min(h) AS h FROM r GROUP BY 1, 2), g AS (SELECT hops, source, count(*) AS size, count(*) FILTER (node = source // 2 OR node = source // 3) AS good FROM d, (SELECT unnest([1, 2]) AS hops) WHERE h <= hops GROUP BY 1, 2) SELECT hops, count(*) AS n, round(avg(size), 6) AS mean_size, round(avg(good / size), 6) AS precision, round(avg(good / 2), 6) AS recall FROM g GROUP BY 1")
def hop_expansion(spark, sf):
    """Seeds grown by one and two hops: size, precision and recall."""
    e = edges(spark, sf)
    d = G.distances(G.undirected(e), e.select(F.col("src").alias("node")).distinct(), 2)
    grown = d.withColumn("hops", F.explode(F.array(F.lit(1), F.lit(2)))).where("distance <= hops")
    each = grown.groupBy("hops", "source").agg(F.count("*").alias("size"), F.count_if(F.expr("node = floor(source / 2) or node = floor(source / 3)")).alias("good"))
    return each.groupBy("hops").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg(F.col("good") / F.col("size")), 6).alias("precision"), F.round(F.avg(F.col("good") / 2), 6).alias("recall"))


@query("SELECT conv_id, turn, CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / (count(*) OVER w - 1), 6) END AS position FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def relative_position(spark, sf):
    w = W.partitionBy("conv_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("turn")) - 1
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(n == 1, 0.5).otherwise(F.round(F.try_divide(i, n - 1), 6)).alias("position"))


@query("WITH n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, turn AS src, next AS dst FROM n WHERE next IS NOT NULL UNION ALL SELECT conv_id, next, turn FROM n WHERE next IS NOT NULL")
def sequential_edges(spark, sf):
    n = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("dst")).where("dst is not null")
    return n.unionByName(n.select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("WITH c AS (SELECT * FROM conversations) SELECT 'belongs_to' AS relation, count(*) AS n FROM c UNION ALL SELECT 'next', CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM c GROUP BY conv_id) UNION ALL SELECT 'cites', count(*) FROM c WHERE turn > 1 UNION ALL SELECT 'cited_by', count(*) FROM c WHERE turn > 1")
def hetero_edges_counts(spark, sf):
    """Typed edges of turns (paragraphs) and conversations (cases): belonging,
    sequence, and citations both ways."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    typed = lambda df, kind: df.select(F.lit(kind).alias("relation"))
    follow = c.withColumn("n", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return typed(c, "belongs_to").unionByName(typed(follow, "next")).unionByName(typed(c.where("turn > 1"), "cites")).unionByName(typed(c.where("turn > 1"), "cited_by")).groupBy("relation").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(greatest(0, least(1, date_diff('day', DATE '1954-01-01', CAST(o_orderdate AS DATE)) / 26297)), 9) AS judged, round(least(1, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 1825), 9) AS duration FROM orders")
def date_features(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.round(V.normal_date(d), 9).alias("judged"), F.round(F.least(F.lit(1.0), F.datediff(d, F.lit("1992-01-01").cast("date")) / 1825), 9).alias("duration"))


@query(f"WITH p AS ({PAIRS}) SELECT count(*) AS kept, count(*) FILTER (from_no = 1) AS into_anchor FROM p WHERE NOT (from_id % 20 = 0) AND NOT (to_id % 20 = 0 AND from_no IN (0, 1))")
def edge_masking(spark, sf):
    """Training masks: no edge out of an anchor, no citation into one."""
    return pairs(spark, sf).where("not (from_id % 20 = 0 or (to_id % 20 = 0 and from_no in (0, 1)))").agg(F.count("*").alias("kept"), F.count_if(F.col("from_no") == 1).alias("into_anchor"))


@query()
def betweenness_sampled(spark, sf):
    """From 500 pivots, picked by a seeded hash: a sampling operator."""
    e = edges(spark, sf)
    pivots = G.ends(e).orderBy(F.md5(F.concat(F.col("node").cast("string"), F.lit("-42"))), "node").limit(500)
    return G.betweenness(e, pivots).select("node", F.round("centrality", 9).alias("centrality"))
