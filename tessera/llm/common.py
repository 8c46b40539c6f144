"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is
    unset (local tests) a temporary folder of this machine is used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


#: Spark deletes a job's shuffle files when the job ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote for ``df``; call it only when nothing reads it any more."""
    spark = df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows (two numbers each) that are broadcast to take rows out.
MOST_REJECTED = 1_000_000


def row_keys(*of: Column) -> list[Column]:
    """Two 64-bit hashes that name rows by these values, nulls told apart from one another."""
    values = [x for c in of for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values[::-1])]


def without(docs: DataFrame, keys: list[Column], rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not in ``rejected`` (__k1, __k2).

    The rejected keys are written and counted: up to MOST_REJECTED they are
    broadcast and texts stay where they are, beyond that rows are joined by shuffle.
    """
    gone = stash(rejected.select("__k1", "__k2").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= MOST_REJECTED else gone
    return docs.join(gone, (keys[0] == F.col("__k1")) & (keys[1] == F.col("__k2")), "left_anti")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of text over all rows."""
    return df.agg(F.sum(F.octet_length(text_col))).head()[0] or 0


def parts_for(n_bytes: int, target: int, least: int = 1) -> int:
    """How many pieces of about ``target`` bytes."""
    return max(least, -(-n_bytes // target))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the plain ``lower`` serves where the text has no other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
