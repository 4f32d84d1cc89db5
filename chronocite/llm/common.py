"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the white-space word contracts.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: ASCII-only lower case, as the contracts ask (``lower`` would fold more).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Seconds that executors get to delete files.
PAUSE = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """White-space words of a text; null and blank texts have none."""
    flat = F.translate(F.coalesce(c, F.lit("")), SPACES[1:], " " * 5)
    return F.array_remove(F.split(flat, " "), "")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written to the folder that the cluster shares, to cut lineage.

    The folder is ``spark.checkpoint.dir``, else a folder of the warehouse, which
    a cluster shares as well; never a machine's own temporary folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or all; only what no pending plan still reads."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def free(self) -> None:
        """Let Spark drop the shuffle files of plans that are done and no longer held.

        The last plan stays held until another has run, so an empty one does;
        files go in the background, so there is a pause before more are written.
        """
        self.spark.range(0).count()
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(PAUSE)
