"""Case metadata from XML notices: fields, titles, concepts, procedures, parties
and paragraph citations, all as JVM column expressions.

Fields are XPath over the whole notice.  Values that belong to one repeated
element (a concept, a citation, an annotation) are read from that element's own
text, which ``fragments`` cuts out; such elements don't nest in themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.binding import let

# Where the fields are in a notice (inside our element r).
PATHS = {
    "celex": "//WORK/SAMEAS//TYPE[text()='celex']/../IDENTIFIER/text()",
    "ecli": "//WORK/SAMEAS//TYPE[text()='ecli']/../IDENTIFIER/text()",
    "heading": "/r/NOTICE/EXPRESSION/EXPRESSION_TITLE/VALUE/text()",
    "short": "//EXPRESSION/EXPRESSION_TITLE_ALTERNATIVE/VALUE/text()",
    "short_english": "//EXPRESSION/EXPRESSION_USES_LANGUAGE/OP-CODE[text()='ENG']/../../EXPRESSION_TITLE_ALTERNATIVE/VALUE/text()",
    "languages": "//RESOURCE_LEGAL_USES_ORIGINALLY_LANGUAGE/OP-CODE/text()",
    "date": "//WORK_DATE_DOCUMENT/VALUE/text()",
    "application_date": "//RESOURCE_LEGAL_DATE_REQUEST_OPINION/VALUE/text()",
    "subject_matter": "//WORK_HAS_EXPRESSION[1]/EMBEDDED_NOTICE[1]//RESOURCE_LEGAL_IS_ABOUT_SUBJECT-MATTER//PREFLABEL/text()",
    "advocate_general": "//CASE-LAW_DELIVERED_BY_ADVOCATE-GENERAL/SAMEAS//IDENTIFIER/text()",
    "rapporteur": "//CASE-LAW_DELIVERED_BY_JUDGE/SAMEAS//IDENTIFIER/text()",
    "court": "//WORK_CREATED_BY_AGENT/PREFLABEL/text()",
    "type": "//WORK/WORK_HAS_RESOURCE-TYPE//PREFLABEL[1]/text()",
    "type_newer": "//WORK/RESOURCE_LEGAL_HAS_TYPE_ACT_CONCEPT_TYPE_ACT/PREFLABEL[1]/text()",
    "national_court": "//CASE-LAW_NATIONAL-JUDGEMENT/VALUE/text()",
}
PROCEDURE = "//CASE-LAW_HAS_TYPE_PROCEDURE_CONCEPT_TYPE_PROCEDURE"
PARTIES = {"applicants": "//CASE-LAW_REQUESTED_BY_AGENT", "defendants": "//CASE-LAW_DEFENDED_BY_AGENT", "observations": "//CASE-LAW_COMMENTED_BY_AGENT"}
CITED_CELEX = "//URI/TYPE[text()='celex']/../IDENTIFIER/text()"
#: Concept element of each schema generation, the older first, and its depth.
CONCEPTS = (("CASE-LAW_IS_ABOUT_CONCEPT_CASE-LAW", 5), ("CASE-LAW_IS_ABOUT_CONCEPT_NEW_CASE-LAW", 6))
#: Group labels among the parties that name no party: member states, institutions.
GROUPS = ("EM", "IC")
DEFAULT_COURT = "Court of Justice"
#: Between values of one reading; no XML 1.0 document can hold it.
MARK = "\x01"
#: Of the JVM's 100, by our own, wider count of tokens.
OPERATORS = 90


def texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def first(xml: Column, path: str) -> Column:
    return F.get(texts(xml, path), F.lit(0))


def firsts(xml: Column, paths: list[str]) -> Column:
    """Number of nodes and first value of each path, from as few readings of the
    XML as the JVM allows: an expression may have OPERATORS operators."""
    groups, room = [], 0
    for p in paths:
        cost = 2 * sum(c in "/[](),=@|" for c in p) + 5
        if cost > room:
            groups.append([])
            room = OPERATORS
        groups[-1].append(f"count({p}),'{MARK}',{p}")
        room -= cost
    read = [F.split(F.xpath_string(xml, F.lit("concat(" + f",'{MARK}',".join(g) + ")")), MARK) for g in groups]
    return F.concat(*read)


def nth(values: Column, k: int) -> Column:
    """The value of the k-th path of ``firsts``; null where it has no node."""
    return F.when(F.get(values, F.lit(2 * k)) != "0", F.get(values, F.lit(2 * k + 1)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column made once a row, whatever uses or filters it later."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def fragments(xml: Column, tag: str) -> Column:
    """The text of each element of that name, in order; never null for a text."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<{tag}(?:\s(?:[^>]*[^/>])?)?>.*?</{tag}>)"), F.lit(1))


def document(xml: Column) -> Column:
    """The notice inside one element of ours, without its prolog, so that text
    behind the root is seen by the reader of ``readable`` as well."""
    bare = F.regexp_replace(xml, r"^[\s\ufeff]*(?:<\?xml[^>]*\?>)?\s*(?:<!DOCTYPE[^>\[]*>)?", "")
    return F.concat(F.lit("<r>"), bare, F.lit("</r>"))


def readable(inner: Column) -> Column:
    """Of a ``document``: False for null and for text that a parser refuses."""
    read = F.from_xml(inner, "bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return F.coalesce(read.isNotNull() & read["bad"].isNull(), F.lit(False))


def title(heading: Column) -> Column:
    """The second piece between '#'; null where there is none."""
    return F.trim(F.translate(F.get(F.split(heading, "#"), F.lit(1)), " ", " "))


def keywords(heading: Column) -> Column:
    """Piece 4 of 5 or 3 of 4, split at spaced dashes; null in other headings."""
    pieces = F.split(heading, "#")
    at = F.when(F.size(pieces) == 5, F.get(pieces, F.lit(3))).when(F.size(pieces) == 4, F.get(pieces, F.lit(2)))
    return F.transform(F.split(F.translate(at, " ", " "), r"\s[-–—]\s"), lambda k: F.regexp_replace(k, r"^[ .]+|[ .]+$", ""))


def short_title(xml: Column, english: Column) -> Column:
    """The only one; the first English one of several; else empty."""
    return let(texts(xml, PATHS["short"]), lambda all_of: F.coalesce(F.when(F.size(all_of) == 1, F.get(all_of, F.lit(0))).when(F.size(all_of) > 1, english), F.lit("")))


def concepts(xml: Column) -> Column:
    """Map of the deepest level's code to the labels 'a / b / c'.

    The older generation ends at the first missing level, the newer one skips
    it; the newer is read only where there is none of the older.  Of concepts
    with one code the last counts.
    """
    inside = F.coalesce(F.get(fragments(xml, "EMBEDDED_NOTICE"), F.lit(0)), F.lit(""))
    (old, depth), (new, deeper) = CONCEPTS

    def levels(node: Column, tag: str, depth: int) -> Column:
        values = firsts(node, [f"/{tag}/{tag}_{k}/{part}/text()" for k in range(1, depth + 1) for part in ("IDENTIFIER", "PREFLABEL")])
        return let(values, lambda v: F.array(*[F.struct(nth(v, 2 * k).alias("id"), nth(v, 2 * k + 1).alias("label")) for k in range(depth)]))

    there = lambda x: x["label"].isNotNull() & x["id"].isNotNull()
    missing = lambda all_of: F.array_position(F.transform(all_of, there), F.lit(False))
    unbroken = lambda all_of: F.filter(all_of, lambda x, i: (missing(all_of) == 0) | (i + 1 < missing(all_of)))
    chains = let(
        fragments(inside, old),
        lambda older: F.when(F.size(older) > 0, F.transform(older, lambda node: let(levels(node, old, depth), unbroken)))
        .otherwise(F.transform(fragments(inside, new), lambda node: F.filter(levels(node, new, deeper), there))),
    )
    named = F.transform(F.filter(chains, lambda c: F.size(c) > 0), lambda c: F.struct(F.element_at(c, -1)["id"].alias("id"), F.array_join(F.transform(c, lambda x: x["label"]), " / ").alias("label")))
    return let(named, lambda rows: labelled(F.transform(rows, lambda x: x["id"]), F.transform(rows, lambda x: x["label"])))


def labelled(keys: Column, labels: Column) -> Column:
    """Map of ids to labels from parallel lists, as long as the shorter one; the
    last label of an id counts."""
    n = F.least(F.size(keys), F.size(labels))
    keys, labels = F.slice(keys, F.lit(1), n), F.slice(labels, F.lit(1), n)
    backward, values = F.reverse(keys), F.reverse(labels)
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, F.element_at(values, F.array_position(backward, k).cast("int")))))


def parties(xml: Column, path: str) -> Column:
    """Map of a party's id to its label, without the labels of groups."""
    found = let(texts(xml, path + "/IDENTIFIER/text()"), lambda keys: let(texts(xml, path + "/PREFLABEL/text()"), lambda labels: labelled(keys, labels)))
    return F.map_filter(found, lambda k, _: ~k.isin(*GROUPS))


def procedure(code: Column, label: Column) -> Column:
    """(id, type, result, result_id) of one procedure.

    A label of several pieces is a type and, last, a result; then the code's part
    behind '=' is the result's.  Labels of one piece keep their code whole.
    """
    pieces, codes = F.split(label, r"\s[-–]\s"), F.split(code, "=")
    several = F.size(pieces) > 1
    return F.struct(
        F.when(several, F.get(codes, F.lit(0))).otherwise(code).alias("id"),
        F.when(several, F.get(pieces, F.lit(0))).otherwise(F.trim(F.get(pieces, F.lit(0)))).alias("type"),
        F.when(several, F.element_at(pieces, -1)).alias("result"),
        F.when(several & (F.size(codes) == 2), F.get(codes, F.lit(1))).alias("result_id"),
    )


def procedures(xml: Column) -> Column:
    """Distinct procedures, sorted."""
    codes, labels = texts(xml, PROCEDURE + "/IDENTIFIER/text()"), texts(xml, PROCEDURE + "/PREFLABEL/text()")
    both = F.filter(F.zip_with(codes, labels, lambda c, t: F.struct(c.alias("c"), t.alias("t"))), lambda x: x["c"].isNotNull() & x["t"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(both, lambda x: procedure(x["c"], x["t"]))))


def citations(xml: Column) -> Column:
    """One struct an annotation of a citation of an allowed document: target,
    citing and cited numbers and units.

    What an annotation lacks is null, numbers and unit alike; one that has
    neither side is left out.
    """

    def annotation(celex: Column):
        def read(node: Column) -> Column:
            return let(firsts(node, ["//FRAGMENT_CITING_SOURCE/text()", "//FRAGMENT_CITED_TARGET/text()"]), lambda v: sides(nth(v, 0), nth(v, 1)))

        def sides(source: Column, target: Column) -> Column:
            there = lambda side, value: F.when(side.isNotNull(), value)
            return F.struct(
                celex.alias("target"), there(source, ids.expand_range(source)).alias("from"), there(source, ids.unit(source)).alias("unit"),
                there(target, ids.expand_range(target)).alias("to"), there(target, ids.unit(target)).alias("cited_unit"),
            )

        return read

    roots = F.filter(
        F.transform(fragments(xml, "WORK_CITES_WORK"), lambda r: F.struct(first(r, CITED_CELEX).alias("celex"), fragments(r, "ANNOTATION").alias("notes"))),
        lambda r: ids.allowed_type(r["celex"]),
    )
    each = F.flatten(F.transform(roots, lambda r: F.transform(r["notes"], annotation(r["celex"]))))
    return F.filter(each, lambda x: x["unit"].isNotNull() | x["cited_unit"].isNotNull())


def parse(df: DataFrame, column: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(rows with a column ``meta``, rows whose XML can't be read).

    Null and empty text can't be read; ``__inner`` and ``__firsts`` are our own
    names: the document, and the first values of all paths, null for what can't be
    read.  Each is made once a row; no XPath ever meets what can't be read,
    wherever the optimizer moves filters."""
    names = list(PATHS)
    values = F.when(readable(F.col("__inner")), firsts(F.col("__inner"), ["/r/*", *PATHS.values()]))
    ready = once(once(df, "__inner", document(F.col(column))), "__firsts", values)
    good = F.coalesce(F.get("__firsts", F.lit(0)) == "1", F.lit(False))
    xml = F.when(good, F.col("__inner"))
    path = lambda name: nth(F.col("__firsts"), names.index(name) + 1)
    heading = path("heading")
    meta = F.struct(
        path("celex").alias("celex"), path("ecli").alias("ecli"), ids.celex_to_case(path("celex")).alias("case_id"), title(heading).alias("title"),
        keywords(heading).alias("keywords"), short_title(xml, path("short_english")).alias("short_title"), texts(xml, PATHS["languages"]).alias("languages"),
        F.try_to_date(path("date")).alias("date"), F.try_to_date(path("application_date")).alias("application_date"),
        F.array_distinct(texts(xml, PATHS["subject_matter"])).alias("subject_matter"), concepts(xml).alias("concepts"),
        texts(xml, PATHS["advocate_general"]).alias("advocate_general"), texts(xml, PATHS["rapporteur"]).alias("rapporteur"),
        F.coalesce(path("court"), F.lit(DEFAULT_COURT)).alias("court"), F.coalesce(path("type"), path("type_newer")).alias("type"),
        procedures(xml).alias("procedures"), *[parties(xml, p).alias(name) for name, p in PARTIES.items()],
        path("national_court").alias("national_court"), citations(xml).alias("citations"),
    )
    own = ("__inner", "__firsts")
    return ready.where(good).withColumn("meta", meta).drop(*own), ready.where(~good).drop(*own)
