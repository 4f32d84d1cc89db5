"""Metadata of case notices: a notice is written for each customer, then read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as M
from .lenses import table
from .registry import query

CELEX = "'6' || CAST(1990 + k % 30 AS VARCHAR) || 'CJ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')"
CUSTOMERS = f"SELECT *, {CELEX} AS celex FROM (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation FROM customer) WHERE k % 11 <> 0"

# One notice: cases differ by the remainders of the key.
PARTS = (
    "'<?xml version=\"1.0\"?><NOTICE><WORK><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>', celex, '</IDENTIFIER></URI></SAMEAS>'",
    "IF(k % 2 = 0, '<WORK_CREATED_BY_AGENT><PREFLABEL>General Court</PREFLABEL></WORK_CREATED_BY_AGENT>', '')",
    "'<WORK_DATE_DOCUMENT><VALUE>', CAST(1990 + k % 30 AS STRING), '-03-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'), '</VALUE></WORK_DATE_DOCUMENT></WORK>'",
    "'<EXPRESSION><EXPRESSION_TITLE><VALUE>', CASE k % 3 WHEN 0 THEN concat('Judgment#K', k, ' v ', seg, '.#', seg, ' - tax – duty.#C') WHEN 1 THEN concat('Judgment#K', k, ' v ', seg, '#x#', seg, ' — tax.#C') ELSE 'Judgment' END, '</VALUE></EXPRESSION_TITLE></EXPRESSION>'",
    "'<WORK_HAS_EXPRESSION><EMBEDDED_NOTICE>', IF(k % 2 = 0, '<CASE-LAW_IS_ABOUT_CONCEPT_CASE-LAW>{old}</CASE-LAW_IS_ABOUT_CONCEPT_CASE-LAW>', '<CASE-LAW_IS_ABOUT_CONCEPT_NEW_CASE-LAW>{new}</CASE-LAW_IS_ABOUT_CONCEPT_NEW_CASE-LAW>'), '</EMBEDDED_NOTICE></WORK_HAS_EXPRESSION>'",
    "IF(k % 3 <> 1, '{p}<IDENTIFIER>REFER=NL</IDENTIFIER><PREFLABEL>Preliminary reference - inadmissible</PREFLABEL>{q}', '')",
    "IF(k % 3 <> 0, '{p}<IDENTIFIER>REFER_URG=DN</IDENTIFIER><PREFLABEL>Preliminary reference - urgent procedure – unfounded</PREFLABEL>{q}{p}<IDENTIFIER>REFER_URG=DN</IDENTIFIER><PREFLABEL>Preliminary reference - urgent procedure – unfounded</PREFLABEL>{q}{p}<IDENTIFIER>ANNU=X</IDENTIFIER><PREFLABEL>Annulment</PREFLABEL>{q}', '')",
    "'{o}<IDENTIFIER>EM</IDENTIFIER><PREFLABEL>Member States</PREFLABEL>{c}{o}<IDENTIFIER>N', nation, '</IDENTIFIER><PREFLABEL>Nation ', nation, '</PREFLABEL>{c}'",
    "IF(k % 5 = 0, concat('{o}<IDENTIFIER>N', nation, '</IDENTIFIER><PREFLABEL>Again ', nation, '</PREFLABEL>{c}'), '')",
    "'<WORK_CITES_WORK><URI><TYPE>celex</TYPE><IDENTIFIER>62001CJ', lpad(CAST(k % 100 AS STRING), 4, '0'), '</IDENTIFIER></URI><ANNOTATION>', IF(k % 4 IN (0, 2), concat('<FRAGMENT_CITING_SOURCE>N', k, ' - ', k + 2, '</FRAGMENT_CITING_SOURCE>'), ''), IF(k % 4 IN (0, 1), concat('<FRAGMENT_CITED_TARGET>', k, 'P2</FRAGMENT_CITED_TARGET>'), ''), '</ANNOTATION></WORK_CITES_WORK>'",
    "'<WORK_CITES_WORK><URI><TYPE>celex</TYPE><IDENTIFIER>61990CO0001</IDENTIFIER></URI><ANNOTATION><FRAGMENT_CITED_TARGET>N1</FRAGMENT_CITED_TARGET></ANNOTATION></WORK_CITES_WORK>'",
    "IF(k % 11 = 0, '', '</NOTICE>')",
)


def _levels(tag: str, *at: int) -> str:
    return "".join(f"<{tag}_{k}><IDENTIFIER>{'.'.join(map(str, at[: i + 1]))}</IDENTIFIER><PREFLABEL>level {k}</PREFLABEL></{tag}_{k}>" for i, k in enumerate(at))


def notices(spark, sf):
    """(k, xml); every eleventh lacks its last end tag."""
    old, new = (tag for tag, _ in M.CONCEPTS)
    values = {"{old}": _levels(old, 1, 2, 4), "{new}": _levels(new, 1, 3), "{p}": "<CASE-LAW_HAS_TYPE_PROCEDURE_CONCEPT_TYPE_PROCEDURE>", "{q}": "</CASE-LAW_HAS_TYPE_PROCEDURE_CONCEPT_TYPE_PROCEDURE>", "{o}": "<CASE-LAW_COMMENTED_BY_AGENT>", "{c}": "</CASE-LAW_COMMENTED_BY_AGENT>"}
    made = "concat(" + ", ".join(PARTS) + ")"
    for name, value in values.items():
        made = made.replace(name, value)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"))
    # rows are small and work on one is long, so size says nothing about tasks
    c = c.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    return c.withColumn("celex", F.expr(CELEX.replace("VARCHAR", "STRING"))).select("k", F.expr(made).alias("xml"))


def read(spark, sf):
    return M.parse(notices(spark, sf))[0]


def field(spark, sf, name):
    """(k, value): one field, made once though its rows are taken apart."""
    return M.once(read(spark, sf).select("k", F.col(f"meta.{name}").alias("made")), "value", F.col("made")).select("k", "value")


@query(f"SELECT k, celex, 'C-' || CAST(k % 10000 AS VARCHAR) || '/' || lpad(CAST((1990 + k % 30) % 100 AS VARCHAR), 2, '0') AS case_id, CASE k % 3 WHEN 0 THEN 'K' || k || ' v ' || seg || '.' WHEN 1 THEN 'K' || k || ' v ' || seg END AS title, CASE k % 3 WHEN 0 THEN seg || '|tax|duty' WHEN 1 THEN seg || '|tax' END AS keywords, CASE WHEN k % 2 = 0 THEN 'General Court' ELSE 'Court of Justice' END AS court, make_date(1990 + k % 30, 3, 1 + k % 28) AS date FROM ({CUSTOMERS})")
def metadata_fields(spark, sf):
    return read(spark, sf).select("k", "meta.celex", "meta.case_id", "meta.title", F.array_join("meta.keywords", "|").alias("keywords"), "meta.court", "meta.date")


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN '1.2' ELSE '1.3' END AS code, CASE WHEN k % 2 = 0 THEN 'level 1 / level 2' ELSE 'level 1 / level 3' END AS label FROM ({CUSTOMERS})")
def metadata_concepts(spark, sf):
    """The older generation stops at the missing third level."""
    return field(spark, sf, "concepts").select("k", F.explode("value").alias("code", "label"))


@query(f"SELECT k, 'REFER' AS id, 'Preliminary reference' AS type, 'inadmissible' AS result, 'NL' AS result_id FROM ({CUSTOMERS}) WHERE k % 3 <> 1 UNION ALL SELECT k, 'REFER_URG', 'Preliminary reference', 'unfounded', 'DN' FROM ({CUSTOMERS}) WHERE k % 3 <> 0 UNION ALL SELECT k, 'ANNU=X', 'Annulment', NULL, NULL FROM ({CUSTOMERS}) WHERE k % 3 <> 0")
def metadata_procedures(spark, sf):
    return field(spark, sf, "procedures").select("k", F.inline("value"))


@query(f"SELECT k, 'N' || nation AS id, CASE WHEN k % 5 = 0 THEN 'Again ' ELSE 'Nation ' END || nation AS label FROM ({CUSTOMERS})")
def metadata_parties(spark, sf):
    return field(spark, sf, "observations").select("k", F.explode("value").alias("id", "label"))


@query(f"SELECT k, '62001CJ' || lpad(CAST(k % 100 AS VARCHAR), 4, '0') AS target, CASE WHEN k % 4 IN (0, 2) THEN k || ',' || (k + 1) || ',' || (k + 2) END AS sources, CASE WHEN k % 4 IN (0, 2) THEN 'paragraphs' END AS unit, CASE WHEN k % 4 IN (0, 1) THEN CAST(k AS VARCHAR) END AS targets, CASE WHEN k % 4 IN (0, 1) THEN 'articles' END AS cited_unit FROM ({CUSTOMERS}) WHERE k % 4 <> 3")
def metadata_citations(spark, sf):
    """An annotation without either side, and the citation of an order, go."""
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",")
    each = field(spark, sf, "citations").select("k", F.inline("value"))
    return each.select("k", "target", joined(F.col("from")).alias("sources"), "unit", joined(F.col("to")).alias("targets"), "cited_unit")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 = 0")
def metadata_unreadable(spark, sf):
    return M.parse(notices(spark, sf))[1].select("k")
