"""Micro fixtures with expected values from the formulas, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronocite.functions import cleaning, identifiers, stats, vectors
from chronocite.operators import graph, html, retrieval, verbatim


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_metrics_keep_repeats(spark):
    top = spark.createDataFrame([(1, d, r) for r, d in enumerate((5, 3, 9, 1), 1)], "query_id long, doc_id long, rank int")
    rel = lambda *ds: spark.createDataFrame([(1, d) for d in ds], "query_id long, doc_id long")
    m = retrieval.metrics(top, rel(3, 1), (1, 2, 4)).first()
    assert (m.ap, m.recall_1, m.recall_2, m.recall_4) == (0.5, 0, 0.5, 1)
    m = retrieval.metrics(top, rel(3, 3, 1), (4,)).first()
    assert (round(m.ap, 6), round(m.recall_4, 6)) == (0.333333, 0.666667)


def test_recency(spark):
    want = {"linear": (1.0, [0, 0.25, 0.5]), "exponential": (3.0, [0.049787, 0.105399, 0.223130]), "log": (1.0, [0, 0.192645, 0.415037])}
    for kind, (rate, values) in want.items():
        got = [one(spark, F.round(vectors.recency(F.lit(d), F.lit(200), F.lit(0), kind, rate), 6)) for d in (0, 50, 100)]
        assert got == pytest.approx(values, abs=1e-6)


def test_scaled_equal_scores_give_one(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5)], "query_id int, score double")
    assert [r.x for r in df.select(retrieval.scaled(F.col("score")).alias("x")).collect()] == [1.0, 1.0]


def test_boosts_and_dates(spark):
    assert [one(spark, F.round(vectors.duration_boost(F.lit(y)), 6)) for y in (0.0, 2.5, 4.5)] == [0.043937, 1.0, 0.135335]
    assert one(spark, F.round(vectors.normal_date(F.lit("1990-06-15").cast("date")), 6)) == 0.506293
    assert one(spark, vectors.normal_date(F.lit(None).cast("date"))) == 0.0


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (2, "b1 c1"), (3, "c1")], "id long, text string")
    w = {(r.id, r.term): round(r.weight, 6) for r in retrieval.tfidf(retrieval.terms(docs)).collect()}
    assert w[1, "a1"] == 0.934702 and w[1, "b1"] == 0.355432
    assert round(w[1, "b1"] * w[2, "b1"], 5) == 0.25133


def test_codecs(spark):
    cases = {"C-145/90": "61990CJ0145", "145/90": "61990CJ0145", "T-12/05": "62005TJ0012", "145/50": "62050CJ0145", "1234/10": "62010CJ1234", "abc": None}
    for case, celex in cases.items():
        assert one(spark, identifiers.case_to_celex(F.lit(case))) == celex
    assert one(spark, identifiers.celex_to_case(F.lit("62010CJ0454"))) == "C-454/10"
    allowed = {"62010CJ0454": True, "31995L0046": True, "32003R0001": True, "62010TJ0001": False, "12012E0107": False}
    assert {k: one(spark, identifiers.allowed_type(F.lit(k))) for k in allowed} == allowed


def test_units_and_ranges(spark):
    units = dict(zip("A107 N107 P5 R3 107P1 12 12N3 12L3 12R1 X9".split() + [""], "articles paragraphs pages recitals articles articles paragraphs lines recitals paragraphs unknown".split(), strict=True))
    assert {k: one(spark, identifiers.unit(F.lit(k))) for k in units} == units
    ranges = {"N3 - 5 7": [3, 4, 5, 7], "08P2": [8], "107P1-107P3": [107], "A107": [107], "N12J": [12]}
    assert {k: one(spark, identifiers.expand_range(F.lit(k))) for k in ranges} == ranges
    got = one(spark, cleaning.number_ranges(F.lit("paragraphs 47 to 50 and 53-55")))
    assert {(r.start, r.end) for r in got} == {(53, 55), (47, 50), (50, 53)}


def test_intervals(spark):
    for (k, n), want in {(8, 10): (0.490162, 0.943318), (0, 5): (0, 0.434482), (0, 0): (0, 0)}.items():
        low, high = stats.wilson(F.lit(float(k)), F.lit(float(n)))
        assert (one(spark, F.round(low, 6)), one(spark, F.round(high, 6))) == want
    assert stats.poisson_interval(0) == (0.0, pytest.approx(3.688879, abs=1e-5))
    assert stats.poisson_interval(10) == (pytest.approx(4.795389, abs=1e-5), pytest.approx(18.390356, abs=1e-5))


def test_verbatim():
    run = "alpha bravo charlie delta echo foxtrot golf hotel india"
    text = f"xx {run} yy"
    spans = verbatim.spans(text, f"zz {run} qq")
    assert spans == [(3, 58)]
    assert round(verbatim.share(text, spans), 6) == 0.901639
    assert verbatim.masked(text, spans) == "xx <VERBATIM> yy"
    assert verbatim.spans(text, "alpha bravo charlie") == [] == verbatim.spans(None, run)
    assert verbatim.merged([(0, 60), (75, 140), (200, 260)]) == [(0, 140), (200, 260)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a bb ccc dddd eeeeeeeeeeeeeeeeeeeeeeeeeeeee ".split()), max_size=40), st.lists(st.sampled_from("a bb ccc eeeeeeeeeeeeeeeeeeeeeeeeeeeee".split()), max_size=40))
def test_spans_are_ordered_and_inside(a, b):
    text = " ".join(a)
    got = verbatim.spans(text, " ".join(b))
    assert all(0 <= s < e <= len(text) for s, e in got)
    assert all(x[1] + verbatim.GAP < y[0] for x, y in zip(got, got[1:], strict=False))
    assert 0 <= verbatim.share(text, got) <= 1


def test_cleaning(spark):
    clean = lambda t, **k: one(spark, cleaning.clean(F.lit(t), **k))
    assert clean("25. See  Case C-12/90 and Cases C-1/91, C-2/92 [1990] ECR I-55, paragraph 12 and 13 , of 3 May 2004.") == "See <CASE> and <CASE>, <PARAGRAPH>, of <DATE>."
    assert clean("12 of [1990] x", citations=False, dates=False) == "12 of [1990] x"
    assert clean("3) Joined Cases C–12/90 and 13/90, EU:C:1990:5 (<CASE>) say ' it ' ( so )") == "<CASE> say 'it' (so)"
    assert clean("<CASE>, <CASE>, <PARAGRAPH>, et <CASE>") == "<CASE>, <PARAGRAPH>, <CASE>"
    assert clean("1 May 2004", numbers=False) == "<DATE>"


def test_dates(spark):
    dates = lambda t: one(spark, cleaning.without_dates(F.lit(t)))
    assert dates("a 12.05.2004, 2004-5-1, March 3rd, 2004, 3 mars 2004, 2004 Sept 3, in 2004") == "a <DATE>, <DATE>, <DATE>, <DATE>, <DATE>, in <DATE>"
    assert dates("(OJ 2004 L 1, 1 May 2004) x 2003 (OJ 2001 C 2)") == "(OJ 2004 L 1, 1 May 2004) x <DATE> (OJ 2001 C 2)"
    assert dates("No 2004 17/2004 [2004] (2004)") == "No 2004 17/2004 [2004] (2004)"
    assert dates("(OJ") == "(OJ" and dates("") == "" and one(spark, cleaning.without_dates(F.lit(None).cast("string"))) is None
    assert one(spark, cleaning.language_text(F.lit("<CASE> short"))) is None


def test_html_routes():
    page = "<p class='numero'>1 a</p><p class='numero'>3 c</p><p class='numero'>2 b</p>"
    kind, got = html.numbered(page)
    assert kind == "modern" and sorted(got) == [1, 2]
    assert html.numbered("<table><tr><td><p id='point1'>1</p></td><td>one</td></tr><tr><td><p id='point2'>2</p></td><td>two</td></tr></table>")[1] == {1: "one", 2: "two"}
    assert html.numbered("<dl><dt>1<dd>x<dt>2<dd>y On those grounds z</dl>") == ("definitions", {1: "x", 2: "y"})
    assert html.numbered("<h2>Grounds</h2><p>1 a<p>more<p>2 b<p>On those grounds<p>3 c") == ("sections", {1: "1 a more", 2: "2 b"})
    assert html.numbered("<p>1 BY this 2 THE that 3 SO end</p>") == ("single_block", {1: "1 BY this", 2: "2 THE that", 3: "3 SO end"})
    assert html.numbered(None) == ("none", {})
    act = "<p>Article 1</p><p>text</p><p>Article 2</p><p>more</p><p>Section 1</p><p>gone</p><p>Done at X</p>"
    assert html.articles(act) == [("1", "text"), ("2", "more")]


def test_graph_checks(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src long, dst long")
    assert graph.acyclic(e((1, 2), (2, 3), (1, 3))).count() == 0
    assert graph.acyclic(e((1, 2), (2, 3), (3, 1), (3, 4))).count() > 0
    assert {r.node: r.component for r in graph.weak_components(e((5, 4), (3, 4), (9, 8))).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert sum(r["rank"] for r in graph.pagerank(e((1, 2), (2, 1), (3, 1)), 10).collect()) == pytest.approx(1)
