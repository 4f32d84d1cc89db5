"""The corpus pipeline: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocite.llm import byte_bpe, decontaminate, line_dedup, near_copies, quality_gam
from chronocite.llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of one half or more stay; labels train the model."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__id"), "quality")
    labelled = docs.select("doc_id", "text").join(labels, F.col("doc_id") == F.col("__id"))
    model = quality_gam.train(labelled)
    return docs.where(quality_gam.score(docs, model, F.col("text")) >= 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, of one word or more; every document stays."""
    gone = line_dedup.removals(docs, Scratch(spark, "stage-lines"), least=1)
    return line_dedup.without_lines(docs, gone).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Near copies have a Jaccard similarity of 0.8 or more of their sets of
    five-word shingles.  SimHash fingerprints and their pivot tables propose
    pairs, the sets verify them, and an exact join of the sets finds the links
    that the bits can't tell.
    """
    return near_copies.keep_first(docs, Scratch(spark, "stage-copies"), shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    hit = decontaminate.hits(table(spark, sf_dir, "benchmark"), F.col("text"))
    return docs.where(~decontaminate.contaminated(hit))


def byte_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and what they decode to, as digests."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    coded = docs.select("doc_id", byte_bpe.coded(spark, F.col("text"), raw, public_tokenizers.PATTERN).alias("c"))
    return coded.select("doc_id", "c.n_tokens", "c.ids", F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_encoding),
]
#: SQL can't express the trained and fingerprinted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs.drop("ids")
