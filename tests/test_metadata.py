"""Notices that can't be read, absent fields, repeated ids; numbered texts."""

from pyspark.sql import functions as F

from chronocite.operators import metadata as M
from chronocite.operators import pairs as P

PARTY = "<CASE-LAW_REQUESTED_BY_AGENT><IDENTIFIER>{}</IDENTIFIER><PREFLABEL>{}</PREFLABEL></CASE-LAW_REQUESTED_BY_AGENT>"
TITLES = "<EXPRESSION><EXPRESSION_USES_LANGUAGE><OP-CODE>{}</OP-CODE></EXPRESSION_USES_LANGUAGE><EXPRESSION_TITLE_ALTERNATIVE><VALUE>{}</VALUE></EXPRESSION_TITLE_ALTERNATIVE></EXPRESSION>"


def test_what_cannot_be_read(spark):
    rows = [(1, "<NOTICE/>"), (2, "<NOTICE><WORK></NOTICE>"), (3, None), (4, ""), (5, "<NOTICE><A/></NOTICE><B"), (6, "plain"), (7, "<A/><B/>"), (8, '﻿<?xml version="1.0"?>\n<NOTICE>&amp;</NOTICE>\n')]
    good, bad = M.parse(spark.createDataFrame(rows, "k int, xml string"))
    assert sorted(r.k for r in bad.collect()) == [2, 3, 4, 5, 6, 7]
    metas = {r.k: r.meta for r in good.collect()}
    assert sorted(metas) == [1, 8]
    m = metas[1]
    assert (m.celex, m.title, m.keywords, m.short_title, m.court, m.date) == (None, None, None, "", "Court of Justice", None)
    assert (m.concepts, m.procedures, m.applicants, m.citations, m.languages) == ({}, [], {}, [], [])


def test_no_rows(spark):
    good, bad = M.parse(spark.createDataFrame([], "k int, xml string"))
    assert good.count() == bad.count() == 0


def test_parties_and_short_titles(spark):
    parties = PARTY.format("EM", "Member States") + PARTY.format("GR", "Old") + PARTY.format("IT", "Italy") + PARTY.format("GR", "Greece")
    rows = [(f"<NOTICE>{parties}{TITLES.format('FRA', 'un')}{TITLES.format('ENG', 'one')}</NOTICE>",), (f"<NOTICE>{TITLES.format('FRA', 'un')}</NOTICE>",)]
    a, b = (r.meta for r in M.parse(spark.createDataFrame(rows, "xml string").coalesce(1))[0].collect())
    assert a.applicants == {"GR": "Greece", "IT": "Italy"}
    assert (a.short_title, b.short_title) == ("one", "un")


def test_numbered_text(spark):
    rows = [(12, "12. The Court"), (12, " 12The Court "), (2, "12 months"), (3, ""), (3, "3")]
    got = [r.t for r in spark.createDataFrame(rows, "n int, x string").coalesce(1).select(P.numbered(F.col("n"), F.col("x")).alias("t")).collect()]
    assert got == ["12 The Court", "12 The Court", "2 12 months", "3", "3"]


def test_sets_and_ranges(spark):
    df = spark.createDataFrame([(["b", "a", None, "b"], "x", {"k": 1}, [(3, 5), (3, 5)], 4), (None, None, None, None, 4)], "l array<string>, s string, m map<string,int>, r array<struct<start int, end int>>, n int")
    a, b = df.coalesce(1).select(P.as_set(F.col("l"), "array").alias("l"), P.as_set(F.col("s"), "scalar").alias("s"), P.as_set(F.col("m"), "map").alias("m"), P.in_any(F.col("n"), F.col("r")).alias("i")).collect()
    assert (a.l, a.s, a.m, a.i) == (["a", "b"], ["x"], ["k"], True)
    assert (b.l, b.s, b.m, b.i) == ([], [], [], False)
