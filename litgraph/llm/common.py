"""Helpers of the training-data operators: tables, scratch tables in the shared folder, joins with hot groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litgraph.runtime import checkpoint_dir

HOT_SHARE = 1000
"""A group is hot when it holds over 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot groups."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/litgraph-llm-{spark.sparkContext.applicationId}"


_WRITTEN: list[str] = []  # folders of scratch tables that are still there


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a scratch table that no later step reads."""
    files = df.inputFiles()[:1]
    for path in [p for p in _WRITTEN if files and p.rpartition("/")[2] in files[0]]:
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


def discard_all_but(df: DataFrame) -> None:
    """Deletes this application's scratch tables other than ``df``, which must read from no other one."""
    files = df.inputFiles()[:1]
    for path in [p for p in _WRITTEN if not files or p.rpartition("/")[2] not in files[0]]:
        if path.startswith(scratch_folder(df.sparkSession)):
            _delete(df.sparkSession, path)
            _WRITTEN.remove(path)


def discard_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; call it once their results are written."""
    _delete(spark, scratch_folder(spark))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: Column) -> DataFrame:
    """Inner join of rows with one row per group. Hot groups meet their rows in many salted parts.

    ``size`` is the group's number of rows, ``total`` that of all; the hot keys that are broadcast are fewer than
    HOT_SHARE. ``spread`` deals a hot group's rows to its parts.
    """
    salts = parts(rows.sparkSession)
    is_hot = F.col(size) * HOT_SHARE > total
    hot = groups.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")
    dealt = groups.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [*keys, "_salt"]).drop("_salt")
