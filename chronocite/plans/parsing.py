"""Pages to paragraphs, links and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import html
from .lenses import table
from .registry import query


@query()
def page_paragraphs(spark, sf):
    return html.paragraphs(table(spark, sf, "pages"), "page_id", "html")


@query()
def page_links(spark, sf):
    return html.links(table(spark, sf, "pages"), "page_id", "html")


@query()
def page_title(spark, sf):
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("title"))


@query()
def search_ids(spark, sf):
    """Ids of a paged search answer, namespaces aside, first order, distinct."""
    row = F.concat(F.lit('<r xmlns:s="urn:s"><s:ID_CELEX><s:VALUE>6'), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit("CJ0001</s:VALUE></s:ID_CELEX></r>"))
    ids = F.array_distinct(F.xpath(row, F.lit("//*[local-name()='ID_CELEX']/*[local-name()='VALUE']/text()")))
    return table(spark, sf, "pages").select("page_id", F.explode(ids).alias("celex"))
