"""The ``opN_*`` queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, hmm_lm, line_dedup, oracles, quality_gam, quality_rules, simhash, substring, token_store, url_filter
from .common import Scratch, fold, table


def op1_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of ``pages``, by a rule.

    The test tables have no lists.  The rule, by the length of a host's name,
    makes blocked hosts, hosts blocked for a while and again later, allowed
    hosts, and blocked domains (of a host's last two labels); days count from
    2024-01-01.
    """
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h != ''").distinct().withColumn("d", F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)).withColumn("k", F.length("h"))
    rows = hosts.select("h", "d", "k", F.explode(F.expr("""array(
        named_struct('if', k % 3 = 0, 'list', 'spam', 'kind', 'block', 'pattern', concat('host:', h), 'action', 'add', 'day', k),
        named_struct('if', k % 3 = 0 and k % 2 = 0, 'list', 'spam', 'kind', 'block', 'pattern', concat('host:', h), 'action', 'remove', 'day', k + 90),
        named_struct('if', k % 3 = 0 and k % 4 = 0, 'list', 'spam', 'kind', 'block', 'pattern', concat('host:', h), 'action', 'add', 'day', k + 200),
        named_struct('if', k % 5 = 1, 'list', 'trusted', 'kind', 'allow', 'pattern', concat('host:', h), 'action', 'add', 'day', 150),
        named_struct('if', d != '' and length(d) % 4 = 3, 'list', 'domains', 'kind', 'block', 'pattern', concat('domain:', d), 'action', 'add', 'day', 60),
        named_struct('if', d != '' and length(d) % 4 = 3, 'list', 'domains', 'kind', 'block', 'pattern', concat('domain:', d), 'action', 'remove', 'day', 120),
        named_struct('if', k % 7 = 2, 'list', 'paths', 'kind', 'block', 'pattern', concat('prefix:', h, '/en'), 'action', 'add', 'day', 30))""")).alias("e")).where("e.if")
    return rows.select("e.list", "e.kind", "e.pattern", "e.action", F.expr("timestampadd(DAY, e.day, timestamp_ntz'2024-01-01')").alias("at")).distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's time of fetch is 2024-01-01 and page_id mod 366 days."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("timestampadd(DAY, cast(pmod(page_id, 366) as int), timestamp_ntz'2024-01-01')"))
    return url_filter.judged(captures, op1_entries(pages)).select("page_id", url_filter.host(F.col("url")).alias("host"), "n_active", "lists", "blocked")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*(/[^/?#]+)', 1) AS part, ((page_id % 366) + 366) % 366 AS day FROM pages),
h AS (SELECT DISTINCT host AS h, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS d, length(host) AS k FROM p WHERE host <> ''),
e AS (SELECT DISTINCT * FROM (
    SELECT 'spam' AS list, 'block' AS kind, 'host:' || h AS pattern, 'add' AS action, k AS since FROM h WHERE k % 3 = 0
    UNION ALL SELECT 'spam', 'block', 'host:' || h, 'remove', k + 90 FROM h WHERE k % 3 = 0 AND k % 2 = 0
    UNION ALL SELECT 'spam', 'block', 'host:' || h, 'add', k + 200 FROM h WHERE k % 3 = 0 AND k % 4 = 0
    UNION ALL SELECT 'trusted', 'allow', 'host:' || h, 'add', 150 FROM h WHERE k % 5 = 1
    UNION ALL SELECT 'domains', 'block', 'domain:' || d, 'add', 60 FROM h WHERE d <> '' AND length(d) % 4 = 3
    UNION ALL SELECT 'domains', 'block', 'domain:' || d, 'remove', 120 FROM h WHERE d <> '' AND length(d) % 4 = 3
    UNION ALL SELECT 'paths', 'block', 'prefix:' || h || '/en', 'add', 30 FROM h WHERE k % 7 = 2)),
v AS (SELECT *, lead(since) OVER (PARTITION BY list, pattern ORDER BY since, action) AS until FROM e),
m AS (SELECT p.page_id, v.list, v.kind FROM p JOIN v ON v.action = 'add' AND v.since <= p.day AND (v.until IS NULL OR p.day < v.until) AND p.host <> ''
    AND (v.pattern = 'host:' || p.host OR v.pattern = 'prefix:' || p.host || p.part OR (v.pattern[:7] = 'domain:' AND ('.' || p.host) LIKE '%.' || v.pattern[8:])))
SELECT p.page_id, p.host, count(m.list) AS n_active, coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists,
    coalesce(bool_or(m.kind = 'block') AND NOT bool_or(m.kind = 'allow'), false) AS blocked
FROM p LEFT JOIN m ON m.page_id = p.page_id GROUP BY p.page_id, p.host
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = decontaminate.hits(table(spark, sf_dir, "benchmark"), F.col("text"))
    found = docs.select("doc_id", hit.alias("h"))
    return found.select("doc_id", "h.n_words", "h.n_hit", F.size("h.items").cast("long").alias("n_items"), F.sha2(F.array_join("h.items", ","), 256).alias("items_sha256"), decontaminate.contaminated(F.col("h")).alias("contaminated"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = hmm_lm.score(docs, fold("doc_id", 5) == 1, Scratch(spark, "lm"))
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scratch = Scratch(spark, "rules")
    rows = scratch.save(quality_rules.measured(docs), "measured")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    stratum = F.coalesce("lang", F.lit(""))
    cutoffs = scratch.save(quality_rules.calibrated(rows.join(labels, "doc_id"), stratum, F.col("quality") == 1), "cutoffs")
    return quality_rules.judged(rows, stratum, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        json = f.read()
    root = Scratch(spark, "store").root
    token_store.write(table(spark, sf_dir, "documents"), root, json)
    return token_store.read_digests(spark, root)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    with open(rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    coded = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.coded(spark, F.col("text"), raw, public_tokenizers.PATTERN).alias("c"))
    return coded.select("doc_id", "c.n_tokens", F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1).select("doc_id", "quality")
    model = quality_gam.train(docs.join(labels, "doc_id"))
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), quality_gam.score(docs, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.counted(docs, line_dedup.removals(docs, Scratch(spark, "lines")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = substring.removals(docs, Scratch(spark, "substring"))
    left = docs.join(gone.hint("merge"), "doc_id", "left").select("doc_id", substring.digests(F.col("text"), F.col("gone")).alias("k"))
    return left.select("doc_id", "k.*")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_benchmark_decontamination, op3_lm_scoring, op4_quality_rules, op5_token_store, op6_byte_bpe, op7_quality_classifier, op8_simhash_near_dedup, op9_line_dedup, op10_substring_dedup)}
ORACLES = {"op1_url_filter": OP1_SQL, "op2_benchmark_decontamination": oracles.OP2, "op10_substring_dedup": oracles.OP10}
