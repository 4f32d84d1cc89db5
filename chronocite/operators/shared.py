"""Search of texts by the terms they share: each query against all documents.

A text is the sorted 64-bit hashes of its terms and how often each occurs; words
are told apart by these hashes.  Documents and queries are dealt into blocks of
about ``POSTINGS`` terms, a pair of blocks is one task, and only what may be among
a query's k best comes out: no row a pair of texts, or a term that two share, is
made.  In a block, terms that many hold are a matrix product in single precision,
the others are summed by their lists; what may be among the best, within the
bound of its error, is summed again in double precision.

Inverse document frequencies of terms in more than a ``COMMON``-th of the
documents, which a corpus of any size has few of, are broadcast; the other terms
are joined to theirs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Terms of a block, queries scored at once, cells of the dense matrix, pairs summed at once.
POSTINGS, ROWS, CELLS, PAIRS = 1 << 22, 128, 1 << 25, 1 << 20
#: A pair that shares a listed term costs as much as so many cells of a term in the matrix.
LISTED = 1500
#: A term is broadcast if more than one document of so many holds it, up to this many terms.
COMMON, MOST = 1000, 1 << 18

#: Bytes of terms; all others are blanks.
KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))
FOUND = "query_id long, doc_id long, score double"


class Hashes(dict):
    """Hashes of the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def merged(docs: DataFrame) -> DataFrame:
    """id and text; texts of one id are one, null ids apart."""
    docs = docs.select("id", "text")
    known = docs.where("id is not null")
    if known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return known.groupBy("id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text")).unionByName(docs.where("id is null"))
    return docs


def counted(docs: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, terms, tfs (as bytes) and n of texts (id, text) with a term."""
    out_of = {w.encode() for w in stop}

    def terms_of(text: str | None, hashes: Hashes) -> tuple[bytes, bytes, int]:
        words = Counter(text.encode().translate(KEPT).split()) if text else {}
        tf = {w: n for w, n in words.items() if len(w) > 1 and w not in out_of}
        h = np.fromiter(map(hashes.__getitem__, tf), np.uint64, len(tf)).view(np.int64)
        order = np.argsort(h)
        return h[order].tobytes(), np.fromiter(tf.values(), np.int32, len(tf))[order].tobytes(), len(tf)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for rows in batches:
            got = pd.DataFrame([terms_of(t, hashes) for t in rows["text"]], columns=["terms", "tfs", "n"])
            got.insert(0, "id", rows["id"].to_numpy())
            yield got[got["n"] > 0]

    return docs.select("id", F.lower("text").alias("text")).mapInPandas(made, "id long, terms binary, tfs binary, n int")


def joined(parts: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def frequencies(rows: DataFrame) -> DataFrame:
    """term and n, the texts that hold it; the number of texts is that of term null."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for none, some in rows.groupby("none"):
                terms, n = np.unique(joined(some["terms"], np.int64), return_counts=True)
                yield pd.DataFrame({"term": pd.array(terms, "Int64"), "n": 0 if none else n, "none": int(none)})
                if not none:
                    yield pd.DataFrame({"term": pd.array([None], "Int64"), "n": [len(some)], "none": [0]})

    each = rows.select("terms", F.col("id").isNull().alias("none")).mapInPandas(count, "term long, n long, none int")
    return cut(each.groupBy("term").agg((F.sum("n") + F.max("none")).alias("n")))


def lengths(rows: DataFrame, df: DataFrame, total: int) -> DataFrame:
    """id and size, the length of the vector of tf times idf."""
    some = df.where(F.col("term").isNotNull() & (F.col("n") * COMMON > total)).orderBy(F.desc("n"), "term").limit(MOST).toArrow().to_pandas().sort_values("term")
    held = rows.sparkSession.sparkContext.broadcast((some["term"].to_numpy(np.int64), np.log((1 + total) / (1 + some["n"].to_numpy(float))) + 1))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, idf = held.value
        for rows in batches:
            terms, tf = joined(rows["terms"], np.int64), joined(rows["tfs"], np.int32)
            text = np.repeat(np.arange(len(rows)), rows["n"])
            at = np.searchsorted(common, terms)
            at[at == len(common)] = 0
            mine = common[at] == terms if len(common) else np.zeros(len(terms), bool)
            part = np.bincount(text[mine], (tf[mine] * idf[at[mine]]) ** 2, len(rows)) if mine.any() else np.zeros(len(rows))
            ids = rows["id"].to_numpy(np.int64)
            # the sum so far goes where a term of that hash would, of which the text has none
            yield pd.DataFrame({"id": ids, "term": ids ^ 0x5851F42D4C957F2D, "tf": 0, "part": part})
            yield pd.DataFrame({"id": ids[text[~mine]], "term": terms[~mine], "tf": tf[~mine], "part": 0.0})

    rest = rows.mapInPandas(split, "id long, term long, tf int, part double")
    value = F.coalesce(F.pow(F.col("tf") * idf_of("n", total), 2), F.lit(0.0)) + F.col("part")
    return cut(rest.join(df, "term", "left").groupBy("id").agg(F.sqrt(F.sum(value)).alias("size")))


def idf_of(n: str, total: int) -> Column:
    return F.log((1 + F.lit(total)) / (1 + F.col(n))) + 1


class Block:
    """The lists of a block of documents, and the queries' terms in it."""

    def __init__(self, q: pd.DataFrame, d: pd.DataFrame, sets: bool):
        self.sets, self.own, self.ids = sets, q["id"].to_numpy(np.int64), d["id"].to_numpy(np.int64)
        self.size, self.own_size = d["size"].to_numpy(float), q["size"].to_numpy(float)
        self.weight, self.ends = joined(q["weights"], float), np.append(0, np.cumsum(q["n"].to_numpy(np.int64)))
        known, self.term = np.unique(joined(q["terms"], np.int64), return_inverse=True)
        self.term = self.term.astype(np.int32)
        terms, doc = joined(d["terms"], np.int64), np.repeat(np.arange(len(d), dtype=np.int32), d["n"])
        at = np.searchsorted(known, terms)
        at[at == len(known)] = 0
        mine = known[at] == terms
        self.at, self.doc, self.known = at[mine].astype(np.int32), doc[mine].astype(np.int32), len(known)
        self.tf = np.ones(len(self.at)) if sets else joined(d["tfs"], np.int32)[mine].astype(float)
        self.begin = np.searchsorted(self.doc, np.arange(len(d) + 1))
        # terms of many pairs are columns of a matrix
        n, held = len(d), np.bincount(self.at, minlength=self.known)
        pairs = held.astype(float) * np.bincount(self.term, minlength=self.known)
        wide = np.argsort(-pairs, kind="stable")[: max(16, min(2048, CELLS // max(1, n)))]
        wide = wide[pairs[wide] > len(q) * n / LISTED]
        self.slot = np.full(self.known, -1)
        self.slot[wide] = np.arange(len(wide))
        s = self.slot[self.at]
        self.matrix = np.zeros((n, len(wide)), np.float32)
        self.matrix[self.doc[s >= 0], s[s >= 0]] = self.tf[s >= 0]
        order = np.flatnonzero(s < 0)
        order = order[np.argsort(self.at[order], kind="stable")]
        self.list_doc, self.list_tf = self.doc[order], self.tf[order]
        self.count = np.where(self.slot < 0, held, 0)
        self.start = np.cumsum(self.count) - self.count

    def scores(self, dot: np.ndarray, row: np.ndarray, col: np.ndarray | slice) -> np.ndarray:
        return dot / (self.own_size[row] + self.size[col] - dot) if self.sets else dot / self.size[col]

    def near(self, a: int, b: int) -> np.ndarray:
        """Scores of queries a to b with all documents; 0: no term is shared."""
        n, lo, hi = len(self.ids), self.ends[a], self.ends[b]
        row, term, w = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.term[lo:hi], self.weight[lo:hi]
        s = self.slot[term]
        asks = np.zeros((b - a, self.matrix.shape[1]), np.float32)
        asks[row[s >= 0], s[s >= 0]] = w[s >= 0]
        dot = asks @ self.matrix.T
        few = np.flatnonzero(self.count[term] > 0)
        row, w, start, count = row[few], w[few], self.start[term[few]], self.count[term[few]]
        ends, x = np.cumsum(count), 0
        while x < len(few):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + PAIRS, "right")))
            c = count[x:y]
            at = np.repeat(start[x:y] - (np.cumsum(c) - c), c)
            at += np.arange(len(at))
            cell = np.repeat(row[x:y] * n, c)
            cell += self.list_doc[at]
            part = np.repeat(w[x:y], c)
            part *= self.list_tf[at]
            dot += np.bincount(cell, part, dot.size).reshape(dot.shape)
            x = y
        return self.scores(dot, np.arange(b - a)[:, None] + a, slice(None)).astype(np.float32)

    def exact(self, row: int, cols: np.ndarray) -> np.ndarray:
        """Scores of a query with some documents, in double precision."""
        asks = np.zeros(self.known)
        asks[self.term[self.ends[row] : self.ends[row + 1]]] = self.weight[self.ends[row] : self.ends[row + 1]]
        count = self.begin[cols + 1] - self.begin[cols]
        at = np.repeat(self.begin[cols] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        dot = np.bincount(np.repeat(np.arange(len(cols)), count), asks[self.at[at]] * self.tf[at], len(cols))
        return self.scores(dot, np.full(len(cols), row), cols)

    def best(self, k: int, older: bool) -> pd.DataFrame:
        """All that may be among a query's k best once scores are rounded to six digits."""
        out = []
        for a in range(0, len(self.own), ROWS):
            b = min(len(self.own), a + ROWS)
            near = self.near(a, b)
            if older:
                near[self.ids[None] >= self.own[a:b, None]] = 0
            else:
                near[self.ids[None] == self.own[a:b, None]] = 0
            n = near.shape[1]
            least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.zeros(b - a, np.float32)
            off = 4 * (np.diff(self.ends[a : b + 1]) + 16) * float(np.finfo(np.float32).eps)
            near[near < (least * (1 - off) - 3e-6)[:, None]] = 0
            for i in range(b - a):
                cols = np.flatnonzero(near[i])
                if not len(cols):
                    continue
                score = self.exact(a + i, cols)
                order = np.lexsort((self.ids[cols], -score))
                cols, score = cols[order], score[order]
                # of equal scores the k least ids
                head = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
                place = np.arange(len(cols)) - np.repeat(head, np.diff(np.append(head, len(cols))))
                kept = (place < k) & (score >= score[min(k, len(score)) - 1] - 1.1e-6)
                out.append((np.full(kept.sum(), self.own[a + i]), self.ids[cols[kept]], score[kept]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), columns, strict=True)))


def search(docs: DataFrame, asked: Column, k: int, *, stop: tuple[str, ...] = (), sets: bool = False, older: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of all that may be among the k best of a query.

    ``docs``: id, text; ``asked`` tells which of them are queries.  Scores are the
    Jaccard similarity of the ``sets`` of terms, else the cosine of tf times
    smoothed idf.  Only documents that share a term are found, with ``older`` only
    those of a lesser id.  Scores are not rounded; of documents with the same
    score, or within what six digits tell apart, no better one is left out.
    """
    docs = merged(docs)
    rows, has_id = counted(docs, stop), docs.where("id is not null")
    known, asks = counted(has_id, stop), counted(has_id.where(asked), stop)
    if sets:
        ones = F.pandas_udf(lambda n: n.map(lambda x: np.ones(x).tobytes()), "binary")
        left = asks.select("id", "terms", ones("n").alias("weights"), "n", F.col("n").cast("double").alias("size"))
        right = known.select("id", "terms", F.lit(None).cast("binary").alias("tfs"), "n", F.col("n").cast("double").alias("size"))
    else:
        df = frequencies(rows)
        total = (df.where("term is null").first() or {"n": 0})["n"]
        size = lengths(known, df, total)

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), x["n"]), "term": joined(x["terms"], np.int64), "tf": joined(x["tfs"], np.int32)})

        @F.pandas_udf("binary")
        def packed(lists: pd.Series) -> pd.Series:
            return lists.map(lambda x: np.asarray(x).tobytes())

        weighted = asks.mapInPandas(listed, "id long, term long, tf int").join(df, "term").join(size, "id").select("id", "size", F.struct("term", (F.col("tf") * F.pow(idf_of("n", total), 2) / F.col("size")).alias("w")).alias("x"))
        lists = weighted.groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("x")).alias("x"))
        left = lists.select("id", packed("x.term").alias("terms"), packed("x.w").alias("weights"), F.size("x").alias("n"), "size")
        # sizes come in rows of their own, which spares a join of all lists
        right = known.select("id", "terms", "tfs", "n", F.lit(None).cast("double").alias("size")).unionByName(size.select("id", F.lit(None).cast("binary").alias("terms"), F.lit(None).cast("binary").alias("tfs"), F.lit(0).alias("n"), "size"))

    def work(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not sets:
            sizes = d.loc[d["terms"].isna(), ["id", "size"]]
            d = d[d["terms"].notna()].drop(columns="size").merge(sizes, on="id")
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return Block(q, d, sets).best(k, older)

    cores = docs.sparkSession.sparkContext.defaultParallelism
    # a text has about a term in twelve characters
    held = docs.agg(F.sum(F.length("text")).alias("all"), F.sum(F.when(asked, F.length("text"))).alias("asked"), F.count("*").alias("n")).first()
    right_parts = max(1, min(cores, held["n"] // 256), -(-(held["all"] or 0) // (12 * POSTINGS)))
    left_parts = max(1, -(-(held["asked"] or 0) // (12 * POSTINGS)))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = left.withColumn("q", at(left_parts)).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(right_parts - 1))))
    # columns of their own, as both sides stem from one table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    to = right.withColumn("d", at(right_parts)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(left_parts - 1))))
    return dealt.groupBy("q", "d").cogroup(to.groupBy("q", "d")).applyInPandas(work, FOUND)
