"""Token ids as binary, in a content-addressed store.

Layout, all tables under one root:

``chunks``     hash, n, payload: each distinct run of ids once.  A rolling hash
               over the last ``WINDOW`` ids cuts the streams, so equal passages
               give equal chunks wherever they stand.
``recipes``    doc order: segment, doc_id, n_tokens, start, root, chunks.
``manifest``   one row a segment (a run of recipes): first start, documents,
               ids, and the Merkle root over its documents' roots.

``payload`` is zstd over little-endian ids, of 16 bits where the vocabulary
fits, else 32.  ``hash`` is the first 16 bytes of the SHA-256 of the unpacked
ids.  A document's root is the SHA-256 over its chunk hashes; a leaf is the
SHA-256 of its id, start, length and root; a segment's root is that of the
Merkle tree over its leaves.  Both readers first make every root again from the
chunk hashes and hold the recipes against their roots and the manifest, then
hold each chunk against its hash and each document's length against its recipe;
any difference, or a missing chunk, raises.

Null and the empty text have only the end id; an empty table gives an empty
store.  Documents come in ascending doc_id, null first; rows with equal ids
follow one another in an order fixed by their roots.  Repeated rows are each
written.  Texts of any length are encoded whole, one buffer at a time, and cut
into chunks of bounded size.  Other columns of the caller are not stored.
"""

from __future__ import annotations

import hashlib
import json as json_
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .words import Tokens, portions

#: Ids that a cut looks at; a cut comes every 2**MASK_BITS ids on average.
WINDOW, MASK_BITS, LEAST, MOST = 8, 9, 128, 4096
#: Word parts, chunks written, and ids of words that a worker remembers; slots for the
#: words (two to the power of); text bytes encoded at once.
REMEMBERED, WRITTEN, POOL, SLOT_BITS, AT_ONCE = 400_000, 100_000, 1 << 24, 21, 1 << 20
#: Documents of a segment, about.
SEGMENT = 50_000
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())

PIECES = "n long, root string, chunks array<struct<hash:binary,n:int,payload:binary>>"
#: How a tokenizer must normalise and part words for the word coder.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Letter runs that the tokenizer's normaliser only lowers: one pre-token each.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet of Latin letters: bytes that print stand for
    themselves, the others for characters from U+0100 on, in order."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    letter = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class Remembered:
    """The ids of words by 64-bit hash.  A hash has one slot, which the last word
    that came there holds; looking words up takes no step a word."""

    def __init__(self, kind: np.dtype):
        self.tags = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at, self.sizes = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(POOL, kind), 1  # the first is left to the caller

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word, where in ``pool`` its ids begin and how many they are; the words that are not known."""
        slot = (h & np.uint64(len(self.tags) - 1)).astype(np.int64)
        at, size = self.at[slot], self.sizes[slot]
        return at, size, np.flatnonzero((self.tags[slot] != h) | (size == 0))

    def put(self, h: np.ndarray, ids: bytes, size: np.ndarray) -> np.ndarray:
        """Where the ids of distinct words now begin; ``get`` before holds as well until ``trim``."""
        new = np.frombuffer(ids, self.pool.dtype)
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        end = self.used + len(new)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], new))
        self.pool[self.used : end] = new
        slot, self.used = (h & np.uint64(len(self.tags) - 1)).astype(np.int64), end
        self.tags[slot], self.at[slot], self.sizes[slot] = h, at, size
        return at

    def trim(self) -> None:
        """Forget all when the pool is full."""
        if self.used > POOL - (POOL >> 4):
            self.sizes[:], self.used, self.pool = 0, 1, self.pool[:POOL].copy()


class WordCoder:
    """Encodes word by word, with a memory of words seen.

    The tokenizer collapses white space and never merges across it, so a text
    has the ids of its white-space words one after another; and a run of ASCII
    marks at a word's end is separate from an ASCII letter or digit before it.
    A run of plain letters goes to the library's model at once.  Words are told
    by 64-bit hashes, and only a new word is cut out of the text.

    Holds for tokenizers with the ``NORMALIZER`` and ``PRE_TOKENIZER`` above
    whose added tokens hold no white space; any other encodes whole texts by
    the library.
    """

    LETTERS = byte_letters()

    def __init__(self, json: str):
        self.tokenizer = Tokenizer.from_str(json)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.letter = np.dtype("<u4" if self.wide else "<u2"), "I" if self.wide else "H"
        self.seen = Remembered(self.kind)
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what ``parts`` was before it was full
        self.hashes = Tokens(fold=False)  # added tokens tell capitals apart
        made = json_.loads(json)
        by_word = made.get("post_processor") is None and made.get("truncation") is None and made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        self.by_word = by_word and not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in made["added_tokens"])

    def part(self, text: str) -> bytes:
        """The ids of a run of plain small letters, or of marks."""
        got = self.parts.get(text)
        if got is None:
            got = self.before.get(text)
            if got is None:
                if text[0].isalpha():
                    ids = [x.id for x in self.tokenizer.model.tokenize(text if text.isascii() else text.translate(self.LETTERS))]
                else:
                    ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                got = array(self.letter, ids).tobytes()
            if 2 * len(self.parts) >= REMEMBERED:
                self.parts, self.before = {}, self.parts
            self.parts[text] = got
        return got

    def coded(self, words: list[bytes]) -> list[bytes]:
        """The ids of words: plain letters by their lower-case form, marks behind
        them by themselves, all else as the whole word."""
        out, odd = [], []
        for w in words:
            core = w.rstrip(PUNCT)
            text = core.decode()
            if not PLAIN.fullmatch(text):
                odd.append(len(out))
                out.append(b"")
            elif len(core) == len(w):
                out.append(self.part(text.lower()))
            else:
                out.append(self.part(text.lower()) + self.part(w[len(core) :].decode()))
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([words[k].decode() for k in odd], add_special_tokens=False), strict=True):
            out[k] = array(self.letter, e.ids).tobytes()
        return out

    def ids_of(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, each with the end id, and where each text ends."""
        if not self.by_word:
            found = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], self.kind), np.cumsum([len(x) for x in found])
        raw = b"\n".join(texts)
        h, begin, end = self.hashes.spans(raw)
        at, size, lost = self.seen.get(h)
        if len(lost):
            which, found = pd.factorize(h[lost])
            first = np.empty(len(found), np.int64)
            first[which[::-1]] = lost[::-1]
            learned = self.coded([raw[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            n = np.fromiter(map(len, learned), np.int64, len(learned)) // self.kind.itemsize
            at[lost], size[lost] = self.seen.put(found, b"".join(learned), n)[which], n[which]
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
        # the end of each text is one more word
        sizes, from_ = np.ones(len(h) + len(texts), np.int64), np.zeros(len(h) + len(texts), np.int64)
        place = np.arange(len(h)) + of
        sizes[place], from_[place] = size, at
        self.seen.pool[0] = end_id
        last = np.cumsum(sizes)
        out = self.seen.pool[np.repeat(from_ - (last - sizes), sizes) + np.arange(last[-1])]
        self.seen.trim()
        return out, last[np.cumsum(np.bincount(of, minlength=len(texts)) + 1) - 1]


_MIX = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of an id stream asks for a cut."""
    mixed = _MIX[ids & 0xFFFF] ^ ids.astype(np.uint64)
    rolled = mixed.copy()
    for k in range(1, min(WINDOW, len(ids))):
        rolled[k:] += mixed[:-k] << np.uint64(k)
    return np.flatnonzero((rolled >> np.uint64(20)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1


def cuts(marked: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids, of ``LEAST`` or more but the last.

    The hash looks at fewer ids than the least chunk has, so what stands before
    a stream can't move its cuts.
    """
    ends, at = [], 0
    for m in [*marked, n]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST or m == n:
            if m > at:
                ends.append(m)
            at = m
    return ends


def address(ids: bytes) -> bytes:
    return hashlib.sha256(ids).digest()[:16]


_coders: dict[int, WordCoder] = {}


def pieces(docs: DataFrame, json: str, end_id: int) -> DataFrame:
    """doc_id and ``PIECES`` of rows of doc_id and text: the chunks of each
    text's ids and end id.  A chunk that the task has lately put out has no
    payload."""
    held, key = docs.sparkSession.sparkContext.broadcast(json), hash(json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _coders:
            _coders.clear()
            _coders[key] = WordCoder(held.value)
        coder, pack, written = _coders[key], zstandard.ZstdCompressor(3, write_content_size=True), set()
        wide = coder.kind.itemsize
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for begin, stop in portions(texts, AT_ONCE):
                ids, ends = coder.ids_of(texts[begin:stop], end_id)
                raw, found = memoryview(ids.tobytes()), marks(ids)
                at, split = 0, np.searchsorted(found, ends - 1, "right")
                roots, counts, hashes, n, payloads, last = [], [], [], [], [], 0
                for e, k in zip(ends.tolist(), split.tolist(), strict=True):
                    first, own = at, []
                    for c in cuts((found[last:k] - first).tolist(), e - first):
                        part = raw[wide * at : wide * (first + c)]
                        own.append(h := address(part))
                        n.append(first + c - at)
                        payloads.append(None if h in written else pack.compress(part))
                        written.add(h)
                        at = first + c
                    if len(written) > WRITTEN:
                        written.clear()
                    hashes += own
                    counts.append(len(own))
                    roots.append(hashlib.sha256(b"".join(own)).hexdigest())
                    last = int(np.searchsorted(found, e, "right"))
                chunks = pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(n, pa.int32()), pa.array(payloads, pa.binary())], ["hash", "n", "payload"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), chunks)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), pa.array(np.diff(ends, prepend=0)), pa.array(roots), lists], ["doc_id", "n", "root", "chunks"])

    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def write(docs: DataFrame, root: str, json: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, segments: int | None = None) -> None:
    """Encode all documents and write the store under ``root``."""
    spark = docs.sparkSession
    staged = f"{root}/staged"
    pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), json, end_id).write.mode("overwrite").option("compression", "uncompressed").parquet(staged)
    rows = spark.read.parquet(staged)
    (
        rows.select(F.explode("chunks").alias("c")).where("c.payload is not null").select("c.*").groupBy("hash").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
        .write.mode("overwrite").option("compression", "uncompressed").parquet(f"{root}/chunks")
    )
    light = rows.select("doc_id", F.col("n").alias("n_tokens"), F.col("chunks.hash").alias("hashes"), "root")
    n = segments or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SEGMENT))
    ranged = light.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("segment", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{root}/ordered")
    _delete(spark, staged)
    ordered = spark.read.parquet(f"{root}/ordered")
    # one row a segment: small whatever the number of documents
    sums = ordered.groupBy("segment").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents")).orderBy("segment").collect()
    starts, at = {}, 0
    for r in sums:
        starts[r.segment], at = at, at + r.ids
    first = F.create_map([F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0), F.lit(0))
    in_order = W.partitionBy("segment").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(W.unboundedPreceding, -1)
    ordered.withColumn("start", F.coalesce(F.sum("n_tokens").over(in_order), F.lit(0)) + first[F.col("segment")].cast("long")).write.mode("overwrite").parquet(f"{root}/recipes")
    _delete(spark, f"{root}/ordered")
    recipes = spark.read.parquet(f"{root}/recipes")
    manifest(recipes).write.mode("overwrite").parquet(f"{root}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """Segment totals and Merkle roots, made from the chunk hashes; ``wrong``
    counts documents whose own root differs.

    Segments stream by in doc order: a tree keeps one node a level.
    """

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []

        def folded(tree: list[tuple[int, bytes]]) -> bytes:
            node = tree.pop()[1]
            while tree:
                node = hashlib.sha256(tree.pop()[1] + node).digest()
            return node

        for rows in batches:
            for segment, doc, start, n, hashes, stored in rows.itertuples(index=False):
                if now is None or now[0] != segment:
                    if now is not None:
                        out.append((*now[:5], folded(now[5]).hex()))
                    now = [segment, start, 0, 0, 0, []]
                root = hashlib.sha256(b"".join(map(bytes, hashes))).hexdigest()
                now[2], now[3], now[4] = now[2] + 1, now[3] + n, now[4] + (root != stored)
                node = (0, hashlib.sha256(f"{doc}|{start}|{n}|{root}".encode()).digest())
                while now[5] and now[5][-1][0] == node[0]:
                    node = (node[0] + 1, hashlib.sha256(now[5].pop()[1] + node[1]).digest())
                now[5].append(node)
        if now is not None:
            out.append((*now[:5], folded(now[5]).hex()))
        yield pd.DataFrame(out, columns=["segment", "first_start", "documents", "ids", "wrong", "root"])

    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = recipes.select("segment", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "start", "n_tokens", "hashes", "root")
    dealt = rows.repartition(parts, "segment").sortWithinPartitions("segment", "start", "doc", "root")
    return dealt.mapInPandas(roots, "segment int, first_start long, documents long, ids long, wrong long, root string")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _unpacked(payload: bytes, n: int) -> tuple[bytes, np.ndarray]:
    """Raw ids as stored, and as unsigned 32-bit integers."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    return raw, np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u2").astype("<u4")


def _multiply(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


_POWERS: list[list[int]] = []


def _powers() -> list[list[int]]:
    """Matrices over GF(2) that push a CRC past 2**k zero bytes."""
    if not _POWERS:
        bit = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit, CRC-32's polynomial
        m = bit
        for _ in range(3):
            m = [_multiply(m, c) for c in m]
        for _ in range(64):
            _POWERS.append(m)
            m = [_multiply(m, c) for c in m]
    return _POWERS


def crc32_join(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation, from the (crc32, bytes) of its parts."""
    total, powers = 0, _powers()
    for crc, n in parts:
        k = 0
        while n:
            if n & 1:
                total = _multiply(powers[k], total)
            n, k = n >> 1, k + 1
        total ^= crc
    return total


def chunk_digests(store: DataFrame) -> DataFrame:
    """(hash, n, crc of the ids as 32-bit integers) of each chunk, read and checked."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            crcs = []
            for h, n, payload in zip(rows["hash"], rows["n"], rows["payload"], strict=True):
                raw, ids = _unpacked(payload, n)
                if address(raw) != bytes(h):
                    raise ValueError(f"chunk {bytes(h).hex()} does not have its content")
                crcs.append(zlib.crc32(ids.tobytes()))
            yield pd.DataFrame({"hash": rows["hash"], "n": rows["n"], "crc": crcs})

    return store.select("hash", "n", "payload").mapInPandas(digest, "hash binary, n int, crc long")


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    Chunks are read and verified once; documents combine the CRCs of theirs.
    """
    sound(spark, root)
    recipes = spark.read.parquet(f"{root}/recipes")
    listed = recipes.select("doc_id", "start", "n_tokens", F.posexplode("hashes").alias("pos", "hash"))
    found = listed.join(chunk_digests(spark.read.parquet(f"{root}/chunks")), "hash", "left")
    # a repeated row has a start of its own
    whole = found.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "n", "crc"))).alias("parts"))

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([crc32_join([(p["crc"], 4 * p["n"]) for p in row]) for row in parts], dtype="int64")

    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["n"], F.raise_error(F.lit("a chunk is missing")).cast("int")))
    return whole.where(F.when(total == F.col("n_tokens"), True).otherwise(F.raise_error(F.lit("a document has another length than its recipe")).cast("boolean"))).select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start and the ids (array<int>) of each document, verified like the digests."""
    sound(spark, root)
    recipes = spark.read.parquet(f"{root}/recipes")
    listed = recipes.select("doc_id", "start", "n_tokens", F.posexplode("hashes").alias("pos", "hash"))
    found = listed.join(spark.read.parquet(f"{root}/chunks"), "hash", "left")
    whole = found.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "n", "payload"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def unpack(parts: pd.Series, total: pd.Series) -> pd.Series:
        got = []
        for row, n in zip(parts, total, strict=True):
            ids = []
            for p in row:
                if p["payload"] is None:
                    raise ValueError(f"chunk {bytes(p['hash']).hex()} is missing")
                raw, some = _unpacked(p["payload"], p["n"])
                if address(raw) != bytes(p["hash"]):
                    raise ValueError(f"chunk {bytes(p['hash']).hex()} does not have its content")
                ids.append(some.astype("<i4"))
            got.append(np.concatenate(ids))
            if len(got[-1]) != n:
                raise ValueError("a document has another length than its recipe")
        return pd.Series(got, dtype=object)

    return whole.select("doc_id", "start", unpack("parts", "n_tokens").alias("ids"))


def verify(spark: SparkSession, root: str) -> DataFrame:
    """Segments whose manifest row differs from their recipes; none if sound."""
    was, now = spark.read.parquet(f"{root}/manifest"), manifest(spark.read.parquet(f"{root}/recipes"))
    both = was.join(now.withColumnsRenamed({c: f"now_{c}" for c in now.columns if c != "segment"}), "segment", "full")
    return both.where("not (root <=> now_root and ids <=> now_ids and documents <=> now_documents and first_start <=> now_first_start and now_wrong <=> 0L)")


def sound(spark: SparkSession, root: str) -> None:
    """Raise unless recipes, roots and manifest agree."""
    if wrong := verify(spark, root).select("segment").head(5):
        raise ValueError(f"recipes differ from the manifest, in segments {[r.segment for r in wrong]}")
