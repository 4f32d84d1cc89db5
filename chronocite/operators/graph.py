"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration by a reliable checkpoint, in the folder
    of ``spark.checkpoint.dir``, else in a folder of the warehouse."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): labels hop to the least neighbour, then to its label,
    so the number of rounds grows with the logarithm of the diameter."""
    both = undirected(edges).persist()
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("c"))
        hop = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("c"))
        jump = hop.join(hop.select(F.col("node").alias("c"), F.col("c").alias("to")), "c", "left").select("node", F.least("c", F.coalesce("to", "c")).alias("component"))
        after = cut(jump)
        changed = after.join(labels.withColumnRenamed("component", "was"), "node").where("component != was").limit(1).count()
        labels = after
        if not changed:
            return labels


def pagerank(edges: DataFrame, rounds: int = 20, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank); the mass of nodes without links is spread evenly.

    The mass lost in a round is an aggregate of one row inside the round's plan;
    rounds are kept in memory or on executors' disks, and every few rounds a
    checkpoint cuts the lineage.
    """
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("links")), "node", "left"))
    n = nodes.count()
    links, kept = edges.select("src", "dst").persist(), []
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, rounds + 1):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("links").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        sent = links.join(rank.select(F.col("node").alias("src"), (F.col("rank") / F.col("links")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        after = nodes.join(sent, "node", "left").join(F.broadcast(lost), F.lit(True))
        rank = after.select("node", "links", (F.lit((1 - alpha) / max(n, 1)) + alpha * F.col("lost") / max(n, 1) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k == rounds or k % every == 0:
            rank = cut(rank)
            for df in kept:
                df.unpersist()
            kept = []
        else:
            rank = rank.persist()
            kept.append(rank)
    links.unpersist()
    return rank.select("node", "rank")


def distances(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, distance) up to ``most`` hops, level by level.

    Levels outgrow what the plan takes their size to be, so no side of a join is
    gathered in the driver; the last and largest level is not written.
    """
    seen = front = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"))
    for k in range(1, most + 1):
        step = front.select("source", F.col("node").alias("src")).hint("merge").join(edges.hint("merge"), "src").select("source", F.col("dst").alias("node")).distinct()
        front = step.hint("merge").join(seen.hint("merge"), ["source", "node"], "left_anti").withColumn("distance", F.lit(k))
        front = front if k == most else cut(front)
        seen = seen.unionByName(front)
    return seen


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without an incoming edge are peeled off, again
    and again: none if the graph has no cycle."""
    left, n = edges, -1
    while True:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        m = left.count()
        if m in (0, n):
            return left
        n = m


class Leak(ValueError):
    """Links out of nodes that aren't in training."""


def train_edges(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Edges out of training nodes (``train``: node)."""
    return edges.join(train.select(F.col("node").alias("src")), "src", "left_semi")


def check_train_only(edges: DataFrame, train: DataFrame) -> DataFrame:
    """The edges, if all leave training nodes; else ``Leak`` with their number."""
    n = edges.join(train.select(F.col("node").alias("src")), "src", "left_anti").count()
    if n:
        raise Leak(f"{n} edges leave nodes outside training")
    return edges


def ends(edges: DataFrame) -> DataFrame:
    """(node): every node with a link."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def homogeneous(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Typed edges: cites (0), cited_by (1) and, for ``nodes``, loops (2)."""
    both = edges.select("src", "dst", F.lit(0).alias("type")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("type")))
    return both if nodes is None else both.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(2).alias("type")))


def semantic(similar: DataFrame, references: DataFrame, articles: DataFrame) -> DataFrame:
    """Typed edges without citations: similar_to both ways (0), to articles (1),
    back from them (2), between articles both ways (3)."""
    as_type = lambda df, k: df.select("src", "dst", F.lit(k).alias("type"))
    back = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts = [as_type(undirected(similar), 0), as_type(references, 1), as_type(back(references), 2), as_type(undirected(articles), 3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mask_out(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges that don't leave an anchor."""
    return edges.join(anchors.select(F.col("node").alias("src")), "src", "left_anti")


def mask_cases(edges: DataFrame, anchors: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that touch no paragraph of an anchor's case (``members``: node, case)."""
    cases = members.join(anchors, "node", "left_semi").select("case").distinct()
    hidden = members.join(cases, "case", "left_semi").select("node").distinct()
    return mask_out(mask_out(edges, hidden).select(F.col("dst").alias("src"), F.col("src").alias("dst")), hidden).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def mask_leaving(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Without the edges from an anchor to a node that is none."""
    a = anchors.select("node").distinct()
    marked = edges.join(a.select(F.col("node").alias("src"), F.lit(True).alias("__from")), "src", "left").join(a.select(F.col("node").alias("dst"), F.lit(True).alias("__to")), "dst", "left")
    return marked.where("__from is null or __to is not null").drop("__from", "__to")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other share the least of them.

    Each round colours the nodes left by the least node that reaches them; what
    reaches back to its colour's own node, inside the colour, is a component.
    """
    left, done = cut(edges.select("src", "dst").where("src != dst").distinct()), None
    nodes = cut(ends(edges))
    while nodes.limit(1).count():
        colour = _spread(left, nodes.select("node", F.col("node").alias("c")))
        same = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        back = cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = front = cut(colour.where("node = c").select("node", F.col("c").alias("component")))
        while front.limit(1).count():
            step = front.select(F.col("node").alias("src"), "component").join(back, "src").select(F.col("dst").alias("node"), "component").distinct()
            front = cut(step.join(found, "node", "left_anti"))
            found = found.unionByName(front)
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        nodes = cut(nodes.join(found, "node", "left_anti"))
        gone = found.select("node")
        left = cut(mask_out(left, gone).join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, c): the least label among the nodes that reach a node."""
    labels = cut(labels)
    while True:
        got = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
        after = cut(labels.join(got, "node", "left").select("node", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("__changed")))
        labels = after.drop("__changed")
        if not after.where("__changed").limit(1).count():
            return labels


def betweenness(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node, centrality): shares of shortest paths from the pivots (node) through
    a node, scaled to all sources and to [0, 1]; nodes off every path have none.

    Paths are counted level by level away from the pivots, dependencies are
    summed level by level back; rows are (pivot, node) pairs that are reached.
    """
    edges = edges.select("src", "dst").where("src != dst").distinct()
    n, k = ends(edges).count(), pivots.count()
    levels = [cut(pivots.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("source", "node")
    while True:
        step = levels[-1].withColumnRenamed("node", "src").join(edges, "src").groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen, ["source", "node"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("source", "node"))
    through = below = None
    for level in reversed(levels):
        if below is None:
            own = level.withColumn("through", F.lit(0.0))
        else:
            back = below.withColumnRenamed("node", "dst").select("source", "dst", ((1 + F.col("through")) / F.col("paths")).alias("unit")).join(edges, "dst")
            part = back.groupBy("source", F.col("src").alias("node")).agg(F.sum("unit").alias("unit"))
            own = cut(level.join(part, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("unit", F.lit(0.0))).alias("through")))
        through = own if through is None else through.unionByName(own)
        below = own
    scale = n / (max(k, 1) * max((n - 1) * (n - 2), 1))
    return through.where("node != source").groupBy("node").agg((F.sum("through") * scale).alias("centrality"))
