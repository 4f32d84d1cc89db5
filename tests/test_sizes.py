"""Results that small tables don't reach: long keys, large groups, many blocks."""

import hashlib

import duckdb
import numpy as np
import pytest

from chronocite.operators import digests, graph, metadata, retrieval, shared
from chronocite.plans import evaluation, registry


def same(spark, name, folder, *tables):
    """The query's rows are those of its SQL on the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    answer = con.execute(registry.ORACLES[name])
    names = [c[0] for c in answer.description]
    want = sorted(map(str, answer.fetchall()))
    assert want and sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, str(folder)).select(*names).collect()) == want


@pytest.mark.parametrize("key", [1998, 19980, 120_000_000])
def test_numbers_that_are_words_of_the_text(spark, tmp_path, key):
    duckdb.execute(f"copy (select {key}::bigint as p_partkey, 7 as p_size) to '{tmp_path}/part.parquet'")
    same(spark, "highlight", tmp_path, "part")


def vectors(spark, n):
    """Vectors on a coarse grid, so that scores tie; some labels are null, one vector is very common."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (n, 8)) / 2
    v[rng.random(n) < 0.2] = 0.5
    labels = [None if x == 0 else int(x) for x in rng.integers(0, 5, n)]
    df = spark.createDataFrame([(k, k, [float(x) for x in v[k]], labels[k]) for k in range(n)], "id long, time long, vec array<float>, label int")
    return df, np.round(v @ v.T, 6), labels


def rows_out(monkeypatch):
    """The frames that pairs of blocks give."""
    held, paired = [], retrieval.paired
    monkeypatch.setattr(retrieval, "paired", lambda *a, **b: held.append(paired(*a, **b)) or held[-1])
    return held


def test_rank_of_first_is_counted_in_blocks(spark, monkeypatch):
    """a few rows a query and block come out, never a row a pair."""
    n = 700
    df, s, labels = vectors(spark, n)
    held = rows_out(monkeypatch)
    got = {r.query_id: r.pos for r in retrieval.rank_of_first(df).collect()}
    want = {}
    for q in range(n):
        order = sorted(range(q), key=lambda d: (-s[q, d], d))
        want |= next(({q: i} for i, d in enumerate(order) if labels[d] == labels[q] is not None), {})
    assert got == want
    assert sum(x.count() for x in held) <= 2 * 3 * n


def test_recency_keeps_candidates_only(spark, monkeypatch):
    """bounds and the few that may be among the best come out."""
    n = 700
    df, s, _ = vectors(spark, n)
    held = rows_out(monkeypatch)
    rows = retrieval.recency_candidates(df, 10, 0.5).collect()
    for q in (1, 2, 350, n - 1):
        lo, hi = s[q, :q].min(), s[q, :q].max()
        value = lambda d: round((s[q, d] - lo) / max(hi - lo, 1e-8) + 0.5 * (1 - (q - d) / q), 6)  # noqa: B023, E731
        mine = {r.doc_id: r for r in rows if r.query_id == q}
        assert set(sorted(range(q), key=lambda d: (-value(d), d))[:10]) <= set(mine)
        assert {(r.lo, r.hi) for r in mine.values()} == {(lo, hi)} and all(r.score == s[q, r.doc_id] for r in mine.values())
    assert sum(x.count() for x in held) <= 3 * 20 * n


def test_metrics_without_relevant_pairs(spark, monkeypatch):
    """F13-F15: the metrics of a table of relevant pairs, from counts."""
    df, _, labels = vectors(spark, 300)
    monkeypatch.setattr(evaluation, "vectors", lambda *_: df)
    pairs = [(q, d) for q in range(300) for d in range(q) if labels[d] == labels[q] is not None]
    want = retrieval.metrics(retrieval.dense_topk(df, df, 100), spark.createDataFrame(pairs, "query_id long, doc_id long"), (5, 10, 100))
    assert sorted(evaluation.scored(spark, "").collect()) == sorted(want.collect())


def test_a_notice_is_read_few_times(spark):
    """the parser of a notice is in the plan once, however many fields are asked for."""
    df = spark.createDataFrame([(1, "<NOTICE/>")], "k int, xml string")
    good = metadata.parse(df)[0].select("k", "meta.celex", "meta.case_id", "meta.title", "meta.court", "meta.date")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") <= 2
    assert plan.count("xpath") <= 20
    assert good.first().court == "Court of Justice"


def test_sampled_pairs_are_never_sorted(spark):
    """five pairs a query and block reach the window, and they are the least of all."""
    df = retrieval.hashed_sample(spark.range(300), 5, lambda s, d: d < s, block=64)
    md5 = lambda s, d: hashlib.md5(f"{s}-{d}".encode()).hexdigest()
    want = [(s, d) for s in range(300) for d in sorted(range(s), key=lambda d: md5(s, d))[:5]]  # noqa: B023
    assert sorted((r.src, r.dst) for r in df.collect()) == sorted(want)
    assert "(dst#" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


@pytest.mark.parametrize("ids", [[2**53 + 3, 2**52 + 1, 2**52 + 2, (2**53 + 3) // 3], [*range(-30, 1300), *range(90, 120), None, None, -(2**63), 2**63 - 1, 10**18, 10**17 + 1]], ids=["long", "odd"])
def test_pairs_are_hashed_many_at_once(spark, tmp_path, ids):
    """F1 (round 3): no expression hashes a pair at a time; ids of all lengths, negative, repeated and null ones; halves and thirds of long ones."""
    con = duckdb.connect()
    con.execute("create table t (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into t values (?, [0, 1], 0)", [(k,) for k in ids])
    con.execute(f"copy t to '{tmp_path}/embeddings.parquet'")
    same(spark, "negative_sample", tmp_path, "embeddings")
    assert "transform(" not in registry.QUERIES["negative_sample"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("lanes", "left_over"), [(50, 32), (700, 1), (32768, 3)])
def test_least_digests_are_found_however_few_are_looked_at(monkeypatch, lanes, left_over):
    """F1 (round 3): rows with too few digests under the first bound are taken again; few are wanted of some."""
    monkeypatch.setattr(digests, "LEFT_OVER", left_over)
    monkeypatch.setattr(digests, "MASKED", 5000)
    rng = np.random.default_rng(7)
    src, dst = (np.concatenate([rng.permutation(400), rng.integers(-(2**63), 2**63 - 1, 60)]) for _ in "ab")
    wanted = lambda s, d: (d < s) & (d % 3 != s % 5)
    md5 = lambda s, d: hashlib.md5(f"{s}-{d}".encode()).digest()
    want = [(s, d) for s in src.tolist() for d in sorted((d for d in dst.tolist() if wanted(s, d)), key=lambda d: md5(s, d))[:4]]  # noqa: B023
    found = digests.least_pairs(src, dst, 4, wanted, lanes)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(want)


def test_distances_gather_no_side_in_the_driver(spark, monkeypatch):
    """joins are no broadcasts at any estimate, and the last level is not written."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df) or cut(df))
    e = graph.undirected(spark.createDataFrame([(k, k // 2) for k in range(2, 60)], "src long, dst long"))
    d = graph.distances(e, e.select(graph.F.col("src").alias("node")).distinct(), 3)
    assert len(written) == 2 and all("Broadcast" not in x._jdf.queryExecution().executedPlan().toString() for x in (*written, d))
    near = {k: {k} for k in range(1, 60)}
    for k in (1, 2, 3):
        assert {(r.source, r.node) for r in d.where(f"distance = {k}").collect()} == {(a, n) for a in near for b in near[a] for n in (b // 2, 2 * b, 2 * b + 1) if n in near} - {(a, b) for a in near for b in near[a]}
        near = {a: near[a] | {n for b in near[a] for n in (b // 2, 2 * b, 2 * b + 1) if 0 < n < 60} for a in near}


@pytest.mark.parametrize("name", ["bow_jaccard_topk", "tfidf_topk", "tfidf_semantic_edges"])
def test_texts_meet_in_blocks(spark, tmp_path, monkeypatch, name):
    """F7-F9: many blocks, listed and dense terms, repeated and null ids, copies; a few rows a query and block come out."""
    monkeypatch.setattr(shared, "POSTINGS", 300)
    monkeypatch.setattr(shared, "LISTED", 8)
    monkeypatch.setattr(shared, "ROWS", 3)
    held, search = [], shared.search
    monkeypatch.setattr(shared, "search", lambda *a, **b: held.append(search(*a, **b)) or held[-1])
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 12) % 90) for _ in range(500)]
    texts[20:60] = [texts[50]] * 40
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, "w1 of again"), (None, "w1 w2"), (None, "w1 w7"), (500, None), (550, ""), (-50, "w1 w3")]
    con = duckdb.connect()
    con.execute("create table t (doc_id bigint, text varchar)")
    con.executemany("insert into t values (?, ?)", rows)
    con.execute(f"copy t to '{tmp_path}/documents.parquet'")
    same(spark, name, tmp_path, "documents")
    assert held and held[0].groupBy("query_id").count().agg({"count": "max"}).first()[0] < 250
