"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Rounds of boosting visit the features in turn;
each visit fits a shallow tree on the bins of one feature to the logistic
residuals and adds it, shrunk, to that feature's lookup table.  When the single
features are done, the pairs that explain most of what is left get tables of
their own by the same rounds.  A score is the sum of the looked-up entries
through the logistic function: vectorised additions over bins.

The fit uses a bounded sample of labelled rows, the ``MAX_ROWS`` of smallest
hash; scoring reads whole texts.  Null and empty texts get the features of an
empty text and hence a score.  Without labels of both kinds the score is the
labels' smoothed mean for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may use, and with that the driver's share.
MAX_ROWS = 20_000

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "white", "symbol", "mark", "comma_dot", "pipe", "high",
    "distinct", "top_word", "repeated_next", "distinct_pairs", "log_lines", "distinct_lines", "line_words", "one_byte_words", "symbol_words", "mark_words",
]
_IS = np.zeros((8, 256), bool)
for _k, _chars in enumerate((range(65, 91), range(48, 58), b" \t\n\r\x0b\x0c", b"#*$%&<>@^~=+_\\/{}[]", b"!?", b",.;:", b"|", range(128, 256))):
    _IS[_k, list(_chars)] = True


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    share = _IS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = raw.split()
    m = max(len(words), 1)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    follow = words[1:]
    pairs = set(zip(words, follow, strict=False))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - share[2] * n) / m, *share,
        len(count) / m, max(count.values(), default=0) / m, sum(map(bytes.__eq__, words, follow)) / m, len(pairs) / m,
        np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), sum(len(w) == 1 for w in count) / m,
        raw.count(b"%") / m + raw.count(b"$") / m + raw.count(b"&") / m + raw.count(b"#") / m + raw.count(b"*") / m, (raw.count(b"!") + raw.count(b"?")) / m,
    ]


@dataclass
class Model:
    """Bin edges, lookup tables of features and of pairs, and an intercept."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: (first, second, coarse edges of each, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quantile_edges(v: np.ndarray, bins: int) -> np.ndarray:
    e = np.unique(np.quantile(v, np.arange(1, bins) / bins))
    return e[e > v.min()] if len(v) else e


def stumps(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """The best tree of few leaves on ordered bins: Newton steps per bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + l2) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + l2) - cg[-1] ** 2 / (ch[-1] + l2)
            c = int(np.argmax(gain))
            if gain[c] > best[0]:
                best = (gain[c], k, a + c + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """The best tree that cuts once on each axis of a pair's grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return np.zeros_like(g)
    a, ah = cg[:-1, :-1], ch[:-1, :-1]
    b, bh = cg[:-1, -1:] - a, ch[:-1, -1:] - ah
    c, chh = cg[-1:, :-1] - a, ch[-1:, :-1] - ah
    d, dh = cg[-1, -1] - a - b - c, ch[-1, -1] - ah - bh - chh
    gain = sum(x**2 / (y + l2) for x, y in ((a, ah), (b, bh), (c, chh), (d, dh)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = a[i, j] / (ah[i, j] + l2), b[i, j] / (bh[i, j] + l2)
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = c[i, j] / (chh[i, j] + l2), d[i, j] / (dh[i, j] + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, rounds: int = 120, rate: float = 0.12, leaves: int = 3, n_pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 40, l2: float = 5.0) -> Model:
    mean = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(mean / (1 - mean))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [quantile_edges(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            step = rate * stumps(np.bincount(b, y - p, len(model.tables[j])), np.bincount(b, p * (1 - p), len(model.tables[j])), leaves, l2)
            model.tables[j] += step
            z += step[b]
    coarse = [quantile_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-z))

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cell[i] * shape[1] + cell[j], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((float((grid(i, j, y - p) ** 2 / (grid(i, j, p * (1 - p)) + l2)).sum()), i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in gains]
    for _ in range(pair_rounds):
        for t, (_, i, j) in zip(tables, gains, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = rate * quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)), l2)
            t += step
            z += step[cell[i], cell[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], t) for t, (_, i, j) in zip(tables, gains, strict=True)]
    return model


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(matrix(texts)), dtype=object)

    return extracted(text)


def train(labelled: DataFrame, *, text: str = "text", label: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows, those of smallest key hash."""
    picked = labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("k"))
    ends = picked.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if ends is None:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    rows = picked.where(F.col("h") <= ends).select("h", "k", "y", feature_column(F.col("t")).alias("x")).collect()
    rows = sorted(rows, key=lambda r: (r.h, r.k or "", r.y, r.x))[:max_rows]
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows]))


def score(df: DataFrame, model: Model, text: Column) -> Column:
    """The model's probability of label 1 for each text."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(matrix(texts)))

    return scored(text)
