"""Lag, duration, language matrices, intervals, correlations, fits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .lenses import LANGUAGES, PAIRS, languages, pairs, table
from .registry import query

LAG_YEAR, DURATION_YEAR = 365.25, 365.0
LAG = f"SELECT date_diff('day', date_to, date_from) AS lag FROM ({PAIRS}) WHERE date_from >= date_to"


def lags(spark, sf):
    return pairs(spark, sf).where("date_from >= date_to").select(F.datediff("date_from", "date_to").cast("long").alias("lag"), F.year("date_from").alias("year"), F.year("date_to").alias("year_to"))


def percentiles(c: str, *at: int):
    return [F.round(F.percentile(c, p / 100), 6).alias(f"p{p}") for p in at]


@query(f"SELECT count(*) AS n, round(avg(lag / 365.25), 6) AS mean, round(median(lag), 6) AS middle, round(stddev_samp(lag), 6) AS std, round(stddev_pop(lag), 6) AS std_pop, min(lag) AS least, max(lag) AS most, round(quantile_cont(lag, 0.01), 6) AS p1, round(quantile_cont(lag, 0.25), 6) AS p25, round(quantile_cont(lag, 0.75), 6) AS p75, round(quantile_cont(lag, 0.99), 6) AS p99 FROM ({LAG})")
def lag_summary(spark, sf):
    return lags(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.col("lag") / LAG_YEAR), 6).alias("mean"), F.round(F.percentile("lag", 0.5), 6).alias("middle"), F.round(F.stddev("lag"), 6).alias("std"), F.round(F.stddev_pop("lag"), 6).alias("std_pop"), F.min("lag").alias("least"), F.max("lag").alias("most"), *percentiles("lag", 1, 25, 75, 99))


@query(f"WITH y AS (SELECT year(date_to) AS yr, count(*) AS n FROM ({PAIRS}) GROUP BY 1), c AS (SELECT yr, sum(n) OVER (ORDER BY yr) AS cn, sum(n * yr) OVER (ORDER BY yr) AS cy FROM y) SELECT year(date_from) AS year, count(*) AS n, round(avg(year(date_from) - year(date_to)), 6) AS lag, round(max(year(date_from) - (SELECT max(cy) FROM c WHERE c.yr <= year(date_from)) / (SELECT max(cn) FROM c WHERE c.yr <= year(date_from))), 6) AS expected FROM ({PAIRS}) WHERE date_from >= date_to GROUP BY 1")
def adjusted_lag_summary(spark, sf):
    """Mean lag by citing year, and that of citing any earlier year at random."""
    by_year = pairs(spark, sf).groupBy(F.year("date_to").alias("yr")).agg(F.count("*").alias("n"))
    actual = lags(spark, sf).groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(F.col("year") - F.col("year_to")), 6).alias("lag"))
    sums = actual.select("year").join(by_year, F.col("yr") <= F.col("year")).groupBy("year").agg((F.sum(F.col("n") * F.col("yr")) / F.sum("n")).alias("e"))
    return actual.join(sums, "year").select(F.col("year").cast("long").alias("year"), "n", "lag", F.round(F.col("year") - F.col("e"), 6).alias("expected"))


@query(f"WITH h AS (SELECT least(lag // 250, 9) AS bin FROM ({LAG})) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER () / 250, 9) AS density FROM h GROUP BY 1")
def lag_hist(spark, sf):
    """Equal bins; the last takes its right edge and what is beyond."""
    counts = lags(spark, sf).select((F.width_bucket(F.col("lag"), F.lit(0.0), F.lit(2500.0), F.lit(10)) - 1).alias("b")).select(F.least("b", F.lit(9)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bin", "n", F.round(F.col("n") / F.col("t") / 250, 9).alias("density"))


BUCKET = "CASE WHEN d <= 30 THEN '0-30' WHEN d <= 60 THEN '31-60' WHEN d <= 90 THEN '61-90' ELSE '91+' END"
DURATION = "SELECT l_orderkey, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def durations(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("o"))
    return table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("s"), F.col("l_quantity").alias("q")).join(o, "l_orderkey").select("l_orderkey", F.abs(F.datediff("s", "o")).alias("d"), "q")


@query(f"SELECT {BUCKET} AS bucket, count(*) AS n, round(avg(q), 6) AS mean, round(median(q), 6) AS middle, round(sum(q), 6) AS total FROM ({DURATION}) GROUP BY 1")
def duration_bins(spark, sf):
    return durations(spark, sf).groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.percentile("q", 0.5), 6).alias("middle"), F.round(F.sum("q"), 6).alias("total"))


@query(f"SELECT d // 365 AS year, count(*) AS n, round(avg(q), 6) AS mean, round(1.959963985 * stddev_samp(q) / sqrt(count(*)), 6) AS half FROM ({DURATION}) GROUP BY 1")
def duration_mean_ci(spark, sf):
    """Binned mean with the normal 95 % half-width."""
    return durations(spark, sf).groupBy(F.floor(F.col("d") / DURATION_YEAR).alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.round(stats.Z95 * F.stddev("q") / F.sqrt(F.count("*")), 6).alias("half"))


@query("SELECT round(corr(o_totalprice, o_custkey), 6) AS r, count(*) AS n FROM orders")
def corr_pearson(spark, sf):
    return table(spark, sf, "orders").agg(F.round(F.corr("o_totalprice", F.col("o_custkey").cast("double")), 6).alias("r"), F.count("*").alias("n"))


@query("WITH x AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r")
def corr_spearman(spark, sf):
    """Average ranks come from the counts of distinct values, so no task ranks
    all rows."""
    x = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))

    def ranks(c):
        counts = x.groupBy(c).agg(F.count("*").alias("k"))
        before = F.coalesce(F.sum("k").over(W.orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return counts.select(c, (before + (F.col("k") + 1) / 2).alias(f"r{c}"))

    return x.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"), F.count("*").alias("n"))


@query(f"SELECT lang_from, lang_to, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang_from), 6) AS share, round(count(*) * sum(count(*)) OVER () / (sum(count(*)) OVER (PARTITION BY lang_from) * sum(count(*)) OVER (PARTITION BY lang_to)), 6) AS adjusted FROM ({LANGUAGES}) GROUP BY 1, 2")
def language_matrix(spark, sf):
    """Cross counts, row share, and ratio to what the totals lead to expect."""
    m = languages(spark, sf).groupBy("lang_from", "lang_to").agg(F.count("*").alias("n"))
    rows, cols, total = F.sum("n").over(W.partitionBy("lang_from")), F.sum("n").over(W.partitionBy("lang_to")), F.sum("n").over(W.partitionBy())
    return m.select("lang_from", "lang_to", "n", F.round(F.col("n") / rows, 6).alias("share"), F.round(F.col("n") * total / (rows * cols), 6).alias("adjusted"))


@query(f"WITH m AS (SELECT lang_from AS lang, count(*) AS n, count(*) FILTER (lang_from = lang_to) AS same FROM ({LANGUAGES}) GROUP BY 1) SELECT lang, n, same, round(same / n, 6) AS rate FROM m")
def self_citation_rates(spark, sf):
    return languages(spark, sf).groupBy(F.col("lang_from").alias("lang")).agg(F.count("*").alias("n"), F.count_if(F.expr("lang_from = lang_to")).alias("same")).withColumn("rate", F.round(F.try_divide("same", "n"), 6))


@query(f"WITH l AS ({LANGUAGES}), c AS (SELECT lang_to AS lang, count(*) AS cited FROM l GROUP BY 1), a AS (SELECT s_nationkey AS lang, count(*) AS docs FROM supplier GROUP BY 1) SELECT lang, docs, cited, round(docs * (SELECT count(*) FROM l) / (SELECT count(*) FROM supplier), 6) AS expected, round(cited / (docs * (SELECT count(*) FROM l) / (SELECT count(*) FROM supplier)), 6) AS ratio FROM a JOIN c USING (lang)")
def citation_ratio_availability(spark, sf):
    cited = languages(spark, sf).groupBy(F.col("lang_to").alias("lang")).agg(F.count("*").alias("cited"))
    docs = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("lang")).agg(F.count("*").alias("docs"))
    both = docs.withColumn("d", F.sum("docs").over(W.partitionBy())).join(cited.withColumn("c", F.sum("cited").over(W.partitionBy())), "lang")
    expected = F.col("docs") * F.col("c") / F.col("d")
    return both.select("lang", "docs", "cited", F.round(expected, 6).alias("expected"), F.round(F.col("cited") / expected, 6).alias("ratio"))


WILSON = "WITH m AS (SELECT lang_from AS lang, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (lang_from = lang_to) / count(*) AS p FROM ({}) GROUP BY 1) SELECT lang, round(greatest(0, (p + 3.8414588225 / (2*n)) / (1 + 3.8414588225 / n) - 1.959963985 * sqrt(p*(1-p)/n + 3.8414588225/(4*n*n)) / (1 + 3.8414588225 / n)), 6) AS low, round(least(1, (p + 3.8414588225 / (2*n)) / (1 + 3.8414588225 / n) + 1.959963985 * sqrt(p*(1-p)/n + 3.8414588225/(4*n*n)) / (1 + 3.8414588225 / n)), 6) AS high FROM m"


@query(WILSON.format(LANGUAGES))
def wilson_ci(spark, sf):
    m = languages(spark, sf).groupBy(F.col("lang_from").alias("lang")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.expr("lang_from = lang_to")).cast("double").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return m.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH m AS (SELECT lang_to AS lang, CAST(count(*) AS DOUBLE) AS k, CAST(count(DISTINCT case_from) AS DOUBLE) AS c FROM ({LANGUAGES}) GROUP BY 1) SELECT lang, round(k / c, 6) AS ratio, round(k / c * exp(-1.959963985 * sqrt(1 / k + 1 / c)), 6) AS low, round(k / c * exp(1.959963985 * sqrt(1 / k + 1 / c)), 6) AS high FROM m")
def ratio_delta_ci(spark, sf):
    """Ratio of two counts with its delta-method interval on the log scale."""
    m = languages(spark, sf).groupBy(F.col("lang_to").alias("lang")).agg(F.count("*").cast("double").alias("k"), F.count_distinct("case_from").cast("double").alias("c"))
    r, half = F.col("k") / F.col("c"), stats.Z95 * F.sqrt(1 / F.col("k") + 1 / F.col("c"))
    return m.select("lang", F.round(r, 6).alias("ratio"), F.round(r * F.exp(-half), 6).alias("low"), F.round(r * F.exp(half), 6).alias("high"))


@query()
def poisson_ci(spark, sf):
    @F.pandas_udf("low double, high double")
    def interval(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats.poisson_interval(int(x)) for x in n], columns=["low", "high"])

    m = languages(spark, sf).groupBy(F.col("lang_to").alias("lang")).agg(F.count("*").alias("n"))
    return m.withColumn("i", interval("n")).select("lang", "n", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a, list_sort(list(DISTINCT l_linestatus)) AS b FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN list_has_any(a, b) THEN 1 ELSE 0 END), 6) AS overlap, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS same FROM s")
def role_overlap(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("a"), F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.arrays_overlap("a", "b").cast("int")), 6).alias("overlap"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("same"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def linear_fit(spark, sf):
    return table(spark, sf, "lineitem").agg(*[F.round(F.call_function(f"regr_{k}", F.col("l_extendedprice"), F.col("l_quantity")), d).alias(k) for k, d in (("slope", 4), ("intercept", 4), ("r2", 6))])


def solve3(m: list[list[float]], v: list[float]) -> list[float]:
    """Cramer's rule."""
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    d = det(m)
    return [det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / d for k in range(3)]


@query("WITH x AS (SELECT l_quantity / 50 AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) AS n, sum(x) AS a, sum(x*x) AS b, sum(x*x*x) AS c, sum(x*x*x*x) AS d, sum(y) AS p, sum(x*y) AS q, sum(x*x*y) AS r FROM x), e AS (SELECT *, n*(b*d-c*c) - a*(a*d-c*b) + b*(a*c-b*b) AS det FROM s) SELECT round((p*(b*d-c*c) - a*(q*d-c*r) + b*(q*c-b*r)) / det, 3) AS c0, round((n*(q*d-c*r) - p*(a*d-c*b) + b*(a*r-q*b)) / det, 3) AS c1, round((n*(b*r-q*c) - a*(a*r-q*b) + p*(a*c-b*b)) / det, 3) AS c2 FROM e")
def quadratic_fit(spark, sf):
    """Normal equations from sums; one row of sums reaches the driver."""
    x, y = F.col("l_quantity") / 50, F.col("l_extendedprice")
    s = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), *[F.sum(F.pow(x, k)).alias(f"x{k}") for k in range(1, 5)], *[F.sum(y * F.pow(x, k)).alias(f"y{k}") for k in range(3)]).first()
    c = solve3([[s.n, s.x1, s.x2], [s.x1, s.x2, s.x3], [s.x2, s.x3, s.x4]], [s.y0, s.y1, s.y2])
    return spark.createDataFrame([tuple(round(v, 3) for v in c)], "c0 double, c1 double, c2 double")


@query(f"SELECT count(*) AS n, round(1 / avg(d), 9) AS rate, round(avg(ln(d)), 6) AS mu, round(stddev_pop(ln(d)), 6) AS sigma, round(2 - 2 * (count(*) * ln(1 / avg(d)) - sum(d) / avg(d)), 3) AS aic FROM ({DURATION}) WHERE d > 0")
def exponential_lognormal_mle(spark, sf):
    d = F.col("d")
    return durations(spark, sf).where("d > 0").agg(F.count("*").alias("n"), F.round(1 / F.avg(d), 9).alias("rate"), F.round(F.avg(F.log(d)), 6).alias("mu"), F.round(F.stddev_pop(F.log(d)), 6).alias("sigma"), F.round(2 - 2 * (F.count("*") * F.log(1 / F.avg(d)) - F.sum(d) / F.avg(d)), 3).alias("aic"))
