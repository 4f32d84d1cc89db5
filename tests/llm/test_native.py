"""The native operators and the pipeline."""

import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronocite.llm import line_dedup, quality_rules, queries, url_filter
from chronocite.llm.common import Scratch

from . import brute
from .test_contracts import key, pairs, rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_url_filter(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = spark.createDataFrame(
        [("bad", "block", "host:a.example.org", "add", t(5)), ("bad", "block", "host:a.example.org", "remove", t(10)), ("bad", "block", "host:a.example.org", "add", t(20)),
         ("net", "block", "domain:example.org", "add", t(15)), ("good", "allow", "prefix:a.example.org/ok", "add", t(1)), ("bad", "block", "host:b.org", "add", t(3)), ("bad", "block", "host:b.org", "remove", t(3))],
        "list string, kind string, pattern string, action string, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    shots = [(1, "http://a.example.org/x", 4), (2, "https://u:p@A.example.org:80/x", 5), (3, "http://a.example.org", 10), (4, "http://a.example.org/", 16), (5, "http://a.example.org/ok/1?x", 21), (5, "http://a.example.org/ok/1?x", 21), (6, None, 4), (7, "", 4), (8, "no url", 4), (9, "http://xexample.org", 21), (10, "http://b.org", 4), (None, "http://a.example.org/x", 6)]
    captures = spark.createDataFrame([(i, u, t(d), "clash") for i, u, d in shots], "page_id long, url string, fetched string, kind string").withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    got = url_filter.judged(captures, entries)
    assert "Python" not in plan(got) and "Arrow" not in plan(got)
    want = [(1, 0, "", False), (2, 1, "bad", True), (3, 0, "", False), (4, 1, "net", True), (5, 3, "bad,good,net", False), (5, 3, "bad,good,net", False), (6, 0, "", False), (7, 0, "", False), (8, 0, "", False), (9, 0, "", False), (10, 0, "", False), (None, 1, "bad", True)]
    assert rows(got, "page_id", "n_active", "lists", "blocked") == sorted(want, key=key)
    assert url_filter.judged(captures.limit(0), entries).count() == 0
    assert url_filter.judged(captures, entries.limit(0)).where("blocked").count() == 0


def test_op4(spark, docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_quality_rules(spark, SF)
    assert rows(got, *names) == sorted(brute.rule_counts(pairs(real)))
    m = quality_rules.measured(docs)
    assert "Python" not in plan(m)
    base = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    assert rows(base, *names) == sorted(brute.rule_counts(pairs(docs)), key=key)


@pytest.mark.parametrize("n,x,p", [(10, 0, 0.3), (200, 3, 0.05), (1000, 2, 0.004), (5000, 11, 0.004), (50, 20, 0.2)])
def test_binomial_tail(spark, n, x, p):
    got = spark.createDataFrame([(n, x)], "n long, x long").select(quality_rules.binomial_tail(F.col("n"), F.col("x"), p)).first()[0]
    q = Fraction(p)
    exact = float(sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(x + 1))) if x <= n * p else 1.0
    assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    df = spark.range(8000).select((F.col("id") % 2).cast("string").alias("lang"), F.lit(100).alias("n_words"), F.lit(500).alias("word_chars"), F.lit(0).alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.when(F.col("id") % 200 < 2, 42).otherwise(0).alias("n_repeat_words"), F.lit(1).alias("quality"))
    cut = {r.stratum: r for r in quality_rules.calibrated(df, F.col("lang"), F.col("quality") == 1, risk=0.004).collect()}
    for r in cut.values():
        assert r.cut_repeats == 0.45  # 0.4 would reject one good text in a hundred
        assert r.cut_symbols == 0.01
    kept = quality_rules.judged(df.withColumn("n_symbols", F.lit(50)), F.col("lang"), spark.createDataFrame(list(cut.values())))
    assert kept.where("kept").count() == 0
    assert quality_rules.calibrated(df.limit(0), F.col("lang"), F.col("quality") == 1).count() == 0


def test_kept_is_what_the_bounds_certify(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, sf).collect()}
    value = lambda r: {"short_words": r.word_chars / max(r.n_words, 1), "long_words": r.word_chars / max(r.n_words, 1), "symbols": r.n_symbols / max(r.word_chars, 1), "same_lines": r.n_dup_lines / max(r.n_words, 1), "repeats": r.n_repeat_words / max(r.n_words, 1)}
    over = lambda rule, v, c: v > c if rule.up else v < c
    held = {}
    for d in good:
        held.setdefault(lang[d], []).append(value(got[d]))
    level = quality_rules.ERROR / (len(quality_rules.RULES) * len(held))
    few = {k for k, v in held.items() if (1 - quality_rules.RISK) ** len(v) > level}
    pool = [x for k in few for x in held[k]]
    cut = {}
    for k in held:
        rows_ = pool if k in few else held[k]
        n, p = len(rows_), quality_rules.RISK
        for rule in quality_rules.RULES:
            for c in rule.cutoffs:
                x = sum(over(rule, v[rule.name], c) for v in rows_)
                if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)) > level:
                    break
                cut[k, rule.name] = c
    want = {d: not r.base_failed and not any((lang[d], rule.name) in cut and over(rule, value(r)[rule.name], cut[lang[d], rule.name]) for rule in quality_rules.RULES) for d, r in got.items()}
    assert few and cut
    assert {d: r.kept for d, r in got.items()} == want
    assert any(want[d] == r.base_failed for d, r in got.items())  # a certified cutoff rejects
    names = {"own", "of", "cut_repeats", "stratum"}
    extra = spark.createDataFrame([(1, "x", "en", 1, 2, 3, 4)], "doc_id long, text string, lang string, own int, of int, cut_repeats int, stratum int")
    m = quality_rules.measured(extra)
    table = spark.createDataFrame([("en", None, None, None, None, 0.1)], "stratum string, cut_short_words double, cut_long_words double, cut_symbols double, cut_same_lines double, cut_repeats double")
    assert names <= set(quality_rules.judged(m, F.col("lang"), table).columns) and quality_rules.judged(m, F.col("lang"), table).count() == 1


def test_held_out_rejections_stay_within_the_risk(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    m = quality_rules.measured(docs.join(labels, "doc_id"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    stratum = F.coalesce("lang", F.lit(""))
    cutoffs = quality_rules.calibrated(m.where(half), stratum, F.lit(True))
    other = quality_rules.judged(m.where(~half), stratum, cutoffs)
    for r in other.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("kept") & ~F.col("base_failed")).alias("x")).collect():
        bound = len(quality_rules.RULES) * quality_rules.RISK
        assert r.x <= r.n * bound + 3 * math.sqrt(r.n * bound)


def removed(df):
    return {(r.doc, r.no) for r in df.collect()}


def test_op9(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.similar_lines(pairs(real))
    assert removed(line_dedup.removals(real, Scratch(spark, "t"))) == want
    got = queries.op9_line_dedup(spark, SF)
    assert got.agg(F.sum("n_removed")).first()[0] == len(want)
    assert removed(line_dedup.removals(docs, Scratch(spark, "t"))) == brute.similar_lines(pairs(docs))
    assert line_dedup.removals(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_lines_planted(spark):
    import random

    rng = random.Random(3)
    made = []
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(4, 30))] for _ in range(12)]
    for d in range(50):
        lines = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(90)}"
            lines.append(" ".join(w))
        made.append((d // 2 if d % 10 == 0 else d, "\n".join(lines)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = brute.similar_lines(made)
    gone = line_dedup.removals(df, Scratch(spark, "t"))
    assert removed(gone) == want and len(want) > 20
    for r in line_dedup.without_lines(df.where("doc_id not in (0, 5, 10, 15, 20)"), gone).collect():
        was = dict(made)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for n, x in enumerate(was) if (r.doc_id, n) not in want)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    assert 0 < got.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_stages_stand_odd_rows(spark, docs):
    want = sorted(docs.columns)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert sorted(now.columns) == want
        now = spark.createDataFrame(now.collect(), docs.schema)
    corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_no_local_checkpoint():
    from pathlib import Path

    for p in Path(queries.__file__).parent.glob("*.py"):
        assert not re.search("localCheckpoint", p.read_text())
