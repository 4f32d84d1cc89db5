"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last day of the normalised date scale.
FIRST_DAY, LAST_DAY = "1954-01-01", "2025-12-31"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_length(a: Column, guard: float = 1e-10) -> Column:
    n = F.greatest(norm(a), F.lit(guard))
    return F.transform(a, lambda x: x.cast("double") / n)


def recency(doc: Column, query: Column, oldest: Column, kind: str, rate: float) -> Column:
    """Decay with age, relative to the oldest: linear, exponential or log."""
    age = F.when(query > oldest, (query - doc) / (query - oldest)).otherwise(F.lit(0.0))
    if kind == "exponential":
        return F.exp(-rate * age)
    if kind == "log":
        return 1 - F.log1p(age * rate) / F.log1p(F.lit(rate))
    return 1 - age


def normal_date(d: Column) -> Column:
    """Position of a date on the scale, clipped to [0, 1]; null gives 0."""
    whole = F.datediff(F.lit(LAST_DAY).cast("date"), F.lit(FIRST_DAY).cast("date"))
    # greatest and least skip nulls
    return F.when(d.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(d, F.lit(FIRST_DAY).cast("date")) / whole)))


def duration_boost(years: Column, best: float = 2.5, sigma: float = 1.0) -> Column:
    return F.exp(-0.5 * F.pow((years - best) / sigma, 2))


def multihot(values: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.coalesce(F.array_contains(values, v), F.lit(False)).cast("float"))


def sinusoid(x: Column, width: int) -> Column:
    """sin and cos at log-spaced frequencies from 1 to 10,000."""
    half = width // 2
    freq = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.exp(i * F.log(F.lit(10_000.0)) / max(half - 1, 1)))
    return F.concat(F.transform(freq, lambda f: F.sin(x * f)), F.transform(freq, lambda f: F.cos(x * f)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def fused(parts: list[Column], weights: list[float]) -> Column:
    """Sum of equally long vectors, weighted by the softmax of the weights."""
    top = max(weights)
    total = sum(math.exp(w - top) for w in weights)
    shares = [math.exp(w - top) / total for w in weights]
    out = F.transform(parts[0], _times(shares[0]))
    for part, share in zip(parts[1:], shares[1:], strict=True):
        out = F.zip_with(out, F.transform(part, _times(share)), lambda s, x: s + x)
    return out


def _times(share: float):
    return lambda x: x.cast("double") * share


def fitted(parts: list[Column], width: int) -> Column:
    """The parts one after the other, cut or filled with zeros to ``width``; a
    null part is empty."""
    none = F.array().cast("array<double>")
    joined = F.concat(*[F.coalesce(p.cast("array<double>"), none) for p in parts], F.array_repeat(F.lit(0.0), width))
    return F.slice(joined, 1, width)
