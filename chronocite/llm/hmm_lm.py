"""Language-model scoring with a hidden Markov model.

Tokens are lower-case white-space words and one end a text.  Each token has a
class: the ``TOP`` most frequent training tokens have one each, the end has one,
and all others are dealt by their last characters and length into ``TAIL``
classes.  A state emits a class; a class emits a token by its training count:

    P(text) = sum over state paths of prod P(state | before) P(class | state)
              x prod P(token | class)
    P(token | class) = (c - D) / N_class, or D V_class / N_class if not known

with c the token's count, N and V the class's tokens and distinct tokens, and
D = 0.5 (a class without any token gives all to the unknown).  As in the base
model, unknown tokens are one symbol (of each class).

Baum-Welch learns states on all training texts: they are turned into classes
once, two bytes a token, which each round reads; each partition adds up expected
counts of its texts, the sums by class meet in one small table, whose size is
that of the model.  The forward recursion, scaled at each token, gives the exact
likelihood of a text.

Counts of tokens meet texts without any vocabulary being sent around: texts are
dealt into chunks, each chunk asks for the counts of its distinct tokens by a
join, and gets them back beside its texts.  Words of a buffer are told apart by
64-bit hashes, and looked up once.

Null is the empty text, which is its end alone.  Without training texts every
count is zero and the model is uniform over classes; an empty table gives an
empty result.  Repeated rows are each scored, and each count.  A text of any
length is scored whole, by one task, which holds its classes and, in training,
eight numbers a token.  Only the id and the text are read of the caller's columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch
from .words import Tokens, portions

STATES, TOP, TAIL, ROUNDS, DISCOUNT = 8, 1500, 1024, 3, 0.5
#: Tokens that one sweep holds, and text bytes of one chunk, about.
SWEEP, CHUNK_BYTES = 200_000, 8 << 20
#: Distinct tokens whose counts a task holds.
HELD = 500_000
END = "\n"
#: How a class is stored; TOP + TAIL + 1 of them fit.
CLASS = np.dtype("<u2")
LOWER = bytes(c + 32 if c in UPPER.encode() else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


@dataclass
class Model:
    """Start, transition and emission of the states, and the class table."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # class x state
    top: dict[bytes, int]

    @property
    def classes(self) -> int:
        return len(self.emit)


def classes_of(words_: list[bytes], top: dict[bytes, int]) -> np.ndarray:
    """The class of each token: its own, else by its last three bytes and its
    length; the end has class ``len(top)``."""
    if not words_:
        return np.zeros(0, np.int64)
    line = np.frombuffer(b" ".join(words_) + b" ", np.uint8)
    ends = np.flatnonzero(line == 32)
    n = np.diff(ends, prepend=-1) - 1
    last = [np.where(n >= k, line[ends - np.minimum(n, k)], 0).astype(np.int64) for k in (1, 2, 3)]
    tail = (last[0] + 131 * last[1] + 131 * 131 * last[2] + 97 * np.minimum(n // 4, 7)) % TAIL
    own = np.fromiter(map(top.get, words_, repeat(-1)), np.int64, len(words_))
    return np.where(own >= 0, own, len(top) + 1 + tail)


def sweeps(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in sets of like length and bounded number of tokens."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = int(min(len(order) - at, max(1, SWEEP // max(1, lengths[order[at]]))))
        yield order[at : at + n]
        at += n


def laid_out(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes as steps x rows, and the number of rows alive at each step.

    The rows are in descending order of length.
    """
    lengths = np.array([len(s) for s in seqs])
    grid = np.zeros((int(lengths[0]), len(seqs)), np.int32)
    for k, s in enumerate(seqs):
        grid[: len(s), k] = s
    return grid, np.searchsorted(-lengths, -np.arange(len(grid)), side="left")


def forward(model: Model, grid: np.ndarray, alive: np.ndarray, keep: bool = False):
    """Natural log-likelihood of each row; with ``keep``, also emissions, scaled
    forward values and scales of each step."""
    emitted, one = model.emit[grid], np.ones(model.emit.shape[1])
    alpha, scales = (np.zeros_like(emitted) if keep else None), np.ones(grid.shape)
    f = None
    for t in range(len(grid)):
        n = alive[t]
        f = model.start * emitted[t, :n] if t == 0 else f[:n] @ model.step
        if t:
            f *= emitted[t, :n]
        s = f @ one
        f /= s[:, None]
        scales[t, :n] = s
        if keep:
            alpha[t, :n] = f
    total = np.log(scales).sum(0)
    return (total, emitted, alpha, scales) if keep else total


def expected(model: Model, grid: np.ndarray, alive: np.ndarray, counts: dict[str, np.ndarray]) -> None:
    """Add the expected counts of the rows to ``counts``."""
    _, emitted, gamma, scales = forward(model, grid, alive, keep=True)
    emitted /= scales[:, :, None]
    beta, back, moves = np.ones(emitted.shape[1:]), model.step.T.copy(), np.zeros_like(model.step)
    for t in range(len(grid) - 1, -1, -1):
        n = alive[t]
        w = emitted[t, :n]
        w *= beta[:n]
        gamma[t, :n] *= beta[:n]
        if t:
            moves += gamma[t - 1, :n].T @ w  # still the forward values
            beta[:n] = w @ back
    counts["step"] += moves * model.step
    counts["start"] += gamma[0].sum(0)
    # steps past a row's end have zeros
    c, g = grid.ravel().astype(np.intp), gamma.reshape(-1, gamma.shape[2])
    for j in range(g.shape[1]):
        counts["emit"][:, j] += np.bincount(c, g[:, j], model.classes)


def start_model(counts: np.ndarray, top: dict[bytes, int], states: int = STATES) -> Model:
    """States that stay, with emissions bent at random from the corpus's."""
    rng = np.random.default_rng(11)
    base = (counts + 1.0) / (counts + 1.0).sum()
    emit = base[:, None] * np.exp(rng.normal(0, 0.8, (len(counts), states)))
    step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0), top)


def maximised(model: Model, counts: dict[str, np.ndarray], base: np.ndarray) -> Model:
    """The next model; a little of the corpus's emissions keeps all possible."""
    emit = counts["emit"] + 2.0 * base[:, None] + 1e-6
    step = counts["step"] + 0.1
    start = counts["start"] + 0.1
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0), model.top)


def encoded(texts) -> list[bytes]:
    return [t.encode() if t else b"" for t in texts]


def class_sequences(raw: list[bytes], top: dict[bytes, int], hashes: Tokens) -> list[np.ndarray]:
    """The classes of each text's tokens, and of its end."""
    words_, which, of = hashes.vocabulary(raw)
    k = np.append(classes_of(words_, top)[which], len(top))
    ends = np.cumsum(np.bincount(of, minlength=len(raw)))
    return [np.append(k[i:j], len(top)) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def classed(training: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """The classes of each training text (one column ``text``), as bytes."""
    held = training.sparkSession.sparkContext.broadcast(top)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Tokens()
        for batch in batches:
            raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for begin, stop in portions(raw):
                seqs = class_sequences(raw[begin:stop], held.value, hashes)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(CLASS).tobytes() for x in seqs], pa.binary())], ["classes"])

    return training.select("text").mapInArrow(turn, "classes binary")


def baum_welch_round(training: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Expected counts over all training texts (one column ``classes``)."""
    held = training.sparkSession.sparkContext.broadcast(model)
    k = model.emit.shape[1]
    names = [f"s{j}" for j in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sums = {"start": np.zeros(k), "step": np.zeros((k, k)), "emit": np.zeros((m.classes, k))}
        for batch in batches:
            seqs = [np.frombuffer(x, CLASS) for x in batch.column(0).to_pylist()]
            for some in sweeps(np.array([len(s) for s in seqs], int)):
                expected(m, *laid_out([seqs[i] for i in some]), sums)
        table = np.concatenate([sums["emit"], sums["step"], sums["start"][None]])
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(table[used, j])) for j in range(k)], pa.array(used)], [*names, "row"])

    rows = training.select("classes").mapInArrow(count, ", ".join(f"{c} double" for c in names) + ", row long").groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).collect()
    table = np.zeros((model.classes + k + 1, k))
    for r in rows:
        table[r.row] = [r[c] for c in names]
    return {"emit": table[: model.classes], "step": table[model.classes : -1], "start": table[-1]}


def token_counts(training: DataFrame) -> DataFrame:
    """(token, c) over training texts, without ends: a task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = Tokens(), {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["token", "c"])

        for batch in batches:
            raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for begin, stop in portions(raw):
                words_, which, _ = hashes.vocabulary(raw[begin:stop])
                for w, c in zip(words_, np.bincount(which, minlength=len(words_)).tolist(), strict=True):
                    sums[w] = sums.get(w, 0) + c
                if len(sums) > HELD:
                    yield told()
                    sums.clear()
        yield told()

    return training.select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def class_column(token: Column, top: dict[bytes, int]) -> Column:
    """``classes_of`` as a column."""

    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield pd.Series(classes_of([t.encode() for t in names], top), dtype="int32")

    return of(token)


class Numbers(dict):
    """Tokens numbered in the order they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


SCORED = "doc_id string, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Learned:
    """The model, and tokens and distinct tokens of each class, of all, and the number of ends."""

    model: Model
    n_class: np.ndarray
    v_class: np.ndarray
    ends: int

    @property
    def n(self) -> float:
        return float(self.n_class.sum())

    @property
    def v(self) -> float:
        return float(self.v_class.sum())


def learned(training: DataFrame, counts: DataFrame, scratch: Scratch | None = None, *, states: int = STATES, rounds: int = ROUNDS) -> Learned:
    """What the training texts (one column ``text``) teach, given their token
    counts.  With ``scratch``, their classes are written there once."""
    sizes = training.agg(F.count("*").alias("n")).first().n
    most = counts.orderBy(F.desc("c"), "token").limit(TOP).collect()
    top = {r.token.encode(): k for k, r in enumerate(most)}
    sums = counts.groupBy(class_column(F.col("token"), top).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_class, v_class = np.zeros(len(top) + 1 + TAIL), np.zeros(len(top) + 1 + TAIL)
    for r in sums:
        n_class[r.k], v_class[r.k] = r.n, r.v
    n_class[len(top)], v_class[len(top)] = sizes, 1 if sizes else 0
    model = start_model(n_class, top, states)
    base = (n_class + 1.0) / (n_class + 1.0).sum()
    rounds = rounds if sizes else 0
    texts = classed(training, top)
    if scratch and rounds:
        texts = scratch.save(texts, "classes")
    for _ in range(rounds):
        model = maximised(model, baum_welch_round(texts, model), base)
    if scratch and rounds:
        scratch.drop("classes")
    return Learned(model, n_class, v_class, sizes)


def score(docs: DataFrame, held_out: Column, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    # as text: a number with nulls would become a float in pandas
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out.alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = scratch.save(token_counts(training), "counts")
    got = learned(training, counts, scratch, states=states, rounds=rounds)

    # texts by chunk, and the counts that each chunk asks for
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // CHUNK_BYTES))
    # by content as well, so that repeated ids don't meet in one chunk
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(n_chunks)).cast("int")).select("doc_id", "text", "chunk").repartition(n_chunks, "chunk")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, set[bytes]] = {}
        hashes = Tokens()
        for batch in batches:
            for chunk, rows_ in batch.groupby("chunk")["text"]:
                raw = encoded(rows_)
                for begin, stop in portions(raw):
                    found.setdefault(chunk, set()).update(hashes.vocabulary(raw[begin:stop])[0])
        for chunk, names in found.items():
            if names:
                yield pd.DataFrame({"chunk": np.full(len(names), chunk, np.int32), "token": [w.decode() for w in names]})

    wanted = dealt.mapInPandas(asked, "chunk int, token string")
    answers = wanted.join(counts, "token").select("chunk", "token", "c")
    shared = spark.sparkContext.broadcast(got)

    def judge(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        m, n_c, v_c, n, v, ends = (shared.value.model, shared.value.n_class, shared.value.v_class, shared.value.n, shared.value.v, shared.value.ends)
        # numbers for the tokens of the chunk: the known first, others as they come
        number = Numbers(zip(map(str.encode, known["token"]), range(len(known)), strict=True))
        ids, raw, hashes = [], encoded(texts["text"]), Tokens()
        for begin, stop in portions(raw):
            words_, which, of = hashes.vocabulary(raw[begin:stop])
            all_ids = np.fromiter(map(number.__getitem__, words_), np.int64, len(words_))[which]
            ids += np.split(all_ids, np.cumsum(np.bincount(of, minlength=stop - begin))[:-1])
        c = np.zeros(len(number))
        c[: len(known)] = known["c"]
        k = classes_of(list(number), m.top)
        log_base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        inside = np.zeros(len(number))
        some = n_c[k] > 0  # else all is unknown, and certain
        inside[some] = np.log10(np.where(c > 0, c - DISCOUNT, DISCOUNT * v_c[k])[some] / n_c[k][some])
        end_base = np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        end_inside = np.log10((ends - DISCOUNT) / ends) if ends else 0.0
        total = np.zeros(len(texts))
        seqs = [np.append(k[i], len(m.top)) for i in ids]
        for rows_ in sweeps(np.array([len(s) for s in seqs], int)):
            total[rows_] = forward(m, *laid_out([seqs[i] for i in rows_]))
        return pd.DataFrame({
            "doc_id": texts["doc_id"].to_numpy(), "n_tokens": [len(i) + 1 for i in ids], "n_known": [int((c[i] > 0).sum()) + (ends > 0) for i in ids],
            "base_score": [log_base[i].sum() + end_base for i in ids], "score": [inside[i].sum() + end_inside for i in ids] + total / np.log(10),
        })

    judged = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(judge, SCORED)
    return judged.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(int(got.n)).cast("long").alias("train_tokens"), "base_score", "score")
