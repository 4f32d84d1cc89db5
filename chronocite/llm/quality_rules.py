"""Quality rules whose cutoffs are risk-controlled, in DataFrame operations only.

Each rule rejects a text on one side of a cutoff.  Labelled texts are the
holdout: of the good ones, a rule may reject a share of ``RISK`` at most, in each
stratum (language) by itself.  Cutoffs are tried from the mildest to the
strictest; one passes if, were the true share ``RISK`` or more, so few rejections
would have a probability of ``ERROR`` / (rules x strata) at most (exact binomial
tail, Bonferroni over rules and strata, fixed sequence within a rule).  The last
that passes before the first failure is used; where none passes, the rule is
silent in that stratum.  So with probability 1 - ``ERROR`` no rule rejects more
than ``RISK`` of the good texts of any stratum, and all rules together reject
``RISK`` x rules at most (0.1 with the five rules below).

A stratum needs ``least_good`` good texts before any cutoff can pass (308 with
five strata).  Strata
with fewer are pooled into one parent, whose cutoffs they share; the bound then
holds for the pool.  ``calibrated`` tells which strata are pooled and what was
certified.

Null texts have no words.  A null language is a stratum of its own.  Strata
without labels have no cutoffs, an empty holdout certifies none, an empty table
gives an empty result.  Duplicate labels of an id count once each, repeated rows
are each judged, texts of any length are measured whole.  ``measured`` replaces
columns of the names that it makes; ``judged`` keeps all others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, words

RISK, ERROR = 0.02, 0.05
#: Strata that may be sent to every task.
MOST_STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects if ``metric`` is over the cutoff (``up``) or under it."""

    name: str
    metric: str
    up: bool
    cutoffs: tuple[float, ...]  # from the mildest


RULES = (
    Rule("short_words", "word_chars / greatest(n_words, 1)", False, (1.5, 2.0, 2.5, 3.0, 3.25, 3.5)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", True, (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", True, (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    Rule("same_lines", "n_dup_lines / greatest(n_words, 1)", True, (0.2, 0.1, 0.07, 0.05, 0.03, 0.02)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", True, (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and the base counts of its text.

    Clashing columns of ``docs`` are replaced; select what is needed before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    first = docs.withColumns({
        "__w": words(F.col(text)), "__l": lines,
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
    }).drop(text)
    second = first.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.slice(F.transform("__w", lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))), 1, F.greatest(F.size("__w") - 2, F.lit(0))),
    }).drop("__l")
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    third = second.withColumn("__p", F.when(repeats, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("__w")
    same = lambda x, i, k: F.coalesce(F.get("__p", i + k)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("__p", lambda x, i: same(x, i, 1) | same(x, i, -1)), lambda x: x["i"]))
    fourth = third.withColumn("__at", twice)
    # windows of three words: each adds what the one before has not covered
    total = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return fourth.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__p", "__h", "__at")


def log_factorial(n: Column) -> Column:
    """ln n!: exact under 16, else Stirling's series (to double precision)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n < 16, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Bin(n, p) <= x) for x up to n p, else 1.

    Terms go down from x and shrink; those beyond twelve deviations are under
    the precision of a double and left out.
    """
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * F.log(F.lit(p)) + (n - x) * F.log(F.lit(1 - p))
    steps = F.least(x, F.ceil(60 + 12 * F.sqrt(n * p))).cast("int")
    down = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (x - k) / (n - x + k + 1) * ((1 - p) / p)).alias("term")), lambda a: a["sum"],
    )
    return F.when(x > n * p, F.lit(1.0)).otherwise(F.exp(top) * down)


def least_good(risk: float, level: float) -> int:
    """Good texts without a rejection that certify a cutoff at ``level``."""
    return math.ceil(math.log(level) / math.log(1 - risk))


def calibrated(holdout: DataFrame, stratum: Column, good: Column, *, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, pooled, n_good (of the stratum or its pool), and a cutoff for each
    rule (null: silent), from measured rows."""
    names = [f"x_{r.name}_{k}" for r in rules for k in range(len(r.cutoffs))]
    hits = [F.count_if(F.expr(r.metric) > c if r.up else F.expr(r.metric) < c).alias(f"x_{r.name}_{k}") for r in rules for k, c in enumerate(r.cutoffs)]
    sums = holdout.where(good).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"), *hits)
    level = error / (len(rules) * max(1, sums.count()))
    sums = sums.withColumn("pooled", F.col("n") < least_good(risk, level)).withColumn("part", F.when(~F.col("pooled"), F.col("stratum")))
    pools = sums.groupBy("pooled", "part").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
    chosen = []
    for r in rules:
        tried = F.array(*[F.struct(binomial_tail(F.col("n"), F.col(f"x_{r.name}_{k}"), risk).alias("p"), F.lit(c).alias("c")) for k, c in enumerate(r.cutoffs)])
        start = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("double").alias("c"))
        step = lambda a, t: F.struct((a["ok"] & (t["p"] <= level)).alias("ok"), F.when(a["ok"] & (t["p"] <= level), t["c"]).otherwise(a["c"]).alias("c"))
        chosen.append(F.aggregate(tried, start, step, lambda a: a["c"]).alias(f"cut_{r.name}"))
    found = pools.select(F.col("pooled").alias("p"), F.col("part").alias("q"), F.col("n").alias("n_good"), *chosen)
    cuts = [f"cut_{r.name}" for r in rules]
    return sums.join(found, (F.col("pooled") == F.col("p")) & F.col("part").eqNullSafe(F.col("q"))).select("stratum", "pooled", "n_good", *cuts)


def judged(rows: DataFrame, stratum: Column, cutoffs: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measured rows with base_failed and kept."""
    few = cutoffs.count() <= MOST_STRATA
    own, of, cut = fresh(rows, "own"), fresh(rows, "of"), {r.name: fresh(rows, f"cut_{r.name}") for r in rules}
    table = cutoffs.select(F.col("stratum").alias(of), *[F.col(f"cut_{r.name}").alias(cut[r.name]) for r in rules])
    found = rows.withColumn(own, stratum).join((F.broadcast(table) if few else table), F.col(own).eqNullSafe(F.col(of)), "left")
    broken = F.lit(False)
    for r in rules:
        m, c = F.expr(r.metric), F.col(cut[r.name])
        broken = broken | F.coalesce(m > c if r.up else m < c, F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", base).withColumn("kept", ~(base | broken)).drop(own, of, *cut.values())
