"""Readers and writers of the citation tables, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR_SCHEMA = "CELEX_FROM string, TITLE_FROM string, NUMBER_FROM int, DATE_FROM string, TEXT_FROM string, CELEX_TO string, TITLE_TO string, NUMBER_TO int, TEXT_TO string, DATE_TO string"
#: Priority of metadata and judgment files of a case: English, plain, French.
LANGUAGE_ORDER = ("eng", "", "fra")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Citation CSV; rows with any null go; bad dates become null first."""
    rows = spark.read.schema(PAIR_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumns({c: F.try_to_date(c) for c in ("DATE_FROM", "DATE_TO")}).na.drop("any")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """{celex: {paragraphs, meta}} to a row a paragraph; undated cases go."""
    whole = spark.read.text(path, wholetext=True)
    cases = whole.select(F.explode(F.from_json("value", "map<string,struct<paragraphs:map<string,string>,meta:struct<date:string>>>")).alias("celex", "case"))
    rows = cases.select("celex", F.try_to_date("case.meta.date").alias("date"), F.explode("case.paragraphs").alias("number", "text"))
    return rows.select("celex", F.col("number").try_cast("int").alias("number"), "date", "text").where("date is not null and number is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Headered TSV of celex, paragraph number, text; rows that lack one go."""
    rows = spark.read.schema("celex string, number string, query string").option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return rows.withColumn("number", F.col("number").try_cast("int")).where("number is not null and query is not null")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated judgments; ids are split at the last underscore."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 4)
    end = lambda i, k: F.regexp_extract(F.get("p", F.lit(i)), r"^(.*)_(\d+)$", k)
    return parts.select(end(0, 1).alias("query_celex"), end(0, 2).try_cast("int").alias("query_number"), end(2, 1).alias("doc_celex"), end(2, 2).try_cast("int").alias("doc_number")).where("query_number is not null and doc_number is not null")


def read_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """One id a line, of several files: trimmed, no blanks, distinct."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("id")).where("id != ''").distinct()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one JSON array where lines don't parse."""
    lines = spark.read.json(path)
    return spark.read.json(path, multiLine=True) if "_corrupt_record" in lines.columns else lines


def case_files(spark: SparkSession, root: str, kind: str = "metadata.xml") -> DataFrame:
    """celex, path: for each case folder the file of the first language there is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{kind}").load(root).select("path", "modificationTime")
    celex = F.regexp_extract("path", r"/([^/]+)/[^/]*$", 1)
    lang = F.regexp_extract("path", r"/(?:([a-z]{3})_)?[^/]*$", 1)
    order = F.array_position(F.array(*map(F.lit, LANGUAGE_ORDER)), lang)
    return files.select(celex.alias("celex"), "path", "modificationTime", F.when(order > 0, order).otherwise(99).alias("o")).where("celex rlike '^6[0-9]{4}CJ'").groupBy("celex").agg(F.min_by("path", "o").alias("path"), F.min_by("modificationTime", "o").alias("modified"))


def anti_bot(content: Column, marks: tuple[str, ...] = ("not a robot", "captcha", "access denied")) -> Column:
    """A short page (8 KB at most) with a marker of a bot wall."""
    low = F.lower(content)
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains(low, F.lit(m))
    return F.coalesce((F.octet_length(content) <= 8192) & hit, F.lit(False))


def best_version(files: DataFrame) -> DataFrame:
    """celex, lang, n: English, then French if not empty, else the most
    paragraphs; (celex, lang, n) in."""
    order = F.when(F.col("n") == 0, 9).when(F.col("lang") == "eng", 0).when(F.col("lang") == "fra", 1).otherwise(2)
    w = W.partitionBy("celex").orderBy(order, F.desc("n"), "lang")
    return files.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def resolve(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rename the first column that matches each name's aliases, case aside."""
    low = {c.lower(): c for c in df.columns}
    for name, others in aliases.items():
        hit = next((low[a.lower()] for a in (name, *others) if a.lower() in low), None)
        if hit and hit != name:
            df = df.withColumnRenamed(hit, name)
    return df


def write_pairs(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, batch: int | None = None) -> None:
    """JSON lines, dates as ISO strings; at most ``batch`` rows a file."""
    iso = {c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"}
    w = df.withColumns(iso).write.mode("overwrite")
    (w.option("maxRecordsPerFile", batch) if batch else w).json(path)


def merge_batches(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of the last batch."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def write_ids(df: DataFrame, path: str) -> None:
    df.select(F.col("id").cast("string")).orderBy("id").write.mode("overwrite").text(path)


def pending(ids: DataFrame, done: DataFrame) -> DataFrame:
    """Ids without a result yet: the resume of a harvest."""
    return ids.join(done.select("id"), "id", "left_anti")


def read_language_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(celex, number, lang) of {celex: {number: lang}}; a null language is 'unknown'."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("celex", "numbers"))
    return whole.select("celex", F.explode("numbers").alias("number", "lang")).select("celex", F.col("number").try_cast("int").alias("number"), F.coalesce("lang", F.lit("unknown")).alias("lang"))


def write_judgments(paragraphs: DataFrame, path: str) -> None:
    """A JSON line a case: {celex, date, paragraphs: {number: text}}; of equal
    numbers the least text is kept.  Paragraphs: celex, date, number, text."""
    one = paragraphs.where("number is not null").groupBy("celex", "number").agg(F.min("text").alias("text"), F.min("date").alias("date"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: F.struct(x["number"].cast("string"), x["text"]))
    one.groupBy("celex").agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("date"), F.map_from_entries(entry).alias("paragraphs")).write.mode("overwrite").json(path)
