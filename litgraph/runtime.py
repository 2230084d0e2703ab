"""Session-level helpers shared by the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the one the session names. Unset, a temp one in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="litgraph-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads it back, so that loops neither recompute nor lose state with an executor.

    Parquet takes a fraction of a checkpoint's place, as that is not compressed. Columns that Parquet lacks are checkpointed.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/litgraph-cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_rows(df: DataFrame, n: int = 1) -> bool:
    """True when ``df`` holds at least ``n`` rows; reads no more than needed."""
    return df.limit(n).count() >= n
