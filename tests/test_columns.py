"""Statistics against table values; templates, highlights, the index, leaks."""

import math

import pytest
from pyspark.sql import functions as F

from chronocite.functions import stats
from chronocite.functions import templates as T
from chronocite.functions import vectors as V
from chronocite.operators import graph as G
from chronocite.operators.retrieval import Index


@pytest.mark.parametrize(("df", "t"), [(1, 12.7062), (2, 4.30265), (10, 2.22814), (30, 2.04227), (1000, 1.96234)])
def test_student_quantiles(df, t):
    assert stats.t_quantile(df) == pytest.approx(t, rel=1e-5)
    assert stats.t_two_sided(stats.t_quantile(df), df) == pytest.approx(0.05, abs=1e-9)


def test_correlation_p():
    # r = 0.632 is the 5 % point for 10 pairs
    assert stats.correlation_p(0.6319, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.correlation_p(1.0, 5) == 0.0
    assert math.isnan(stats.correlation_p(0.5, 2))


def test_templates(spark):
    none = F.lit(None).cast("array<string>")
    row = spark.range(1).select(
        T.block(none, F.array(F.lit("a"), F.lit(None), F.lit("")), F.lit(None).cast("map<string,string>")).alias("block"),
        T.model_text(F.lit("t"), F.lit(""), query=False).alias("plain"), T.celex_url(F.lit(None).cast("string")).alias("url"),
        T.highlight_terms(F.lit("A v Comm. & Bank"), F.lit("C-12/90"), F.lit("1992-01-01")).alias("terms"), T.highlighted(F.lit("a+b A+B aa+b"), F.array(F.lit("a+b"))).alias("html"),
        T.highlighted(F.lit(None).cast("string"), none).alias("empty"),
    ).first()
    assert (row.block, row.plain, row.url) == ("Keywords: a", "passage: t", None)
    assert row.terms == ["C-12/90", "1992", "Bank", "Comm", "12", "90"]
    assert row.html == '<div class="para-box"><mark class="hl">a+b</mark> <mark class="hl">A+B</mark> aa+b</div>'
    assert row.empty == '<div class="para-box"></div>'


def test_vectors(spark):
    zero, one = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    row = spark.range(1).select(V.cosine(zero, one).alias("c"), V.unit_length(zero).alias("z"), V.fitted([F.lit(None).cast("array<double>"), one], 3).alias("f")).first()
    assert (row.c, row.z, row.f) == (None, [0.0, 0.0], [3.0, 4.0, 0.0])


def test_index(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 3, [1.0, 1.0])], "id long, time long, vec array<double>")
    index = Index().add(rows).add(spark.createDataFrame([(2, 2, [2.0, 0.0])], rows.schema)).remove(spark.createDataFrame([(1,)], "id long"))
    found = [(r.query_id, r.doc_id, r.score) for r in index.search(rows, 2).orderBy("query_id", "rank").collect()]
    assert found == [(3, 2, pytest.approx(2**0.5, abs=1e-6))]
    index.reset()
    with pytest.raises(ValueError, match="nothing"):
        index.rows()


def test_leaks_raise(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    train = spark.createDataFrame([(1,)], "node long")
    with pytest.raises(G.Leak, match="1 edges"):
        G.check_train_only(edges, train)
    assert G.train_edges(edges, train).count() == 1


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src long, dst long")
    got = {r.node: r.component for r in G.strong_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert G.strong_components(edges.limit(0)).count() == 0


def test_betweenness(spark):
    pairs = [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1), (6, 2)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = sorted({x for p in pairs for x in p})
    out = {v: [b for a, b in pairs if a == v] for v in nodes}

    def shortest(a, b):
        found, front = [], [[a]]
        while front and not found:
            front = [[*p, w] for p in front for w in out[p[-1]] if w not in p]
            found = [p for p in front if p[-1] == b]
        return found

    want = dict.fromkeys(nodes, 0.0)
    for a in nodes:
        for b in nodes:
            paths = shortest(a, b) if a != b else []
            for v in {v for p in paths for v in p[1:-1]}:
                want[v] += sum(v in p for p in paths) / len(paths)
    n = len(nodes)
    got = {r.node: r.centrality for r in G.betweenness(edges, G.ends(edges)).collect()}
    assert {v: got.get(v, 0.0) for v in nodes} == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in want.items()})
