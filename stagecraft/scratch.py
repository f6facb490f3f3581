"""Intermediate tables in the shared folder the cluster names.

A table that several branches of a job read is written once and read back: the branches
stay short, and a lost executor costs a re-read instead of a recomputed lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SPLIT = "spark.sql.files.maxPartitionBytes"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_UNITS = {unit: 1 << 10 * k for k, unit in enumerate("bkmgtp")}


def _byte_count(text: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)b?\s*", text.lower()).groups()
    return int(number) * _UNITS[unit or "b"]


@contextmanager
def splits_up_to(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside read files in splits of at most ``size`` bytes.

    What a task keeps of its split (a table of distinct keys, say) is bounded by it, and no row
    moves. A smaller limit of the session holds, and the session's own one is back afterwards.
    """
    own = spark.conf.get(_SPLIT)
    spark.conf.set(_SPLIT, str(min(size, _byte_count(own))))
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, own)


@contextmanager
def batches_up_to(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand Python at most ``rows`` rows at once; a smaller limit of the session
    holds, and the session's own one is back afterwards."""
    own = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, own)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir.

    Only a local run may name no such folder: one is made and set then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stagecraft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Like materialise, in one bucket a shuffle partition: a join or grouping on the keys
    reads it without an exchange. The table is known to this session's catalog only by a
    unique name and lies in the scratch folder."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt as the buckets are, so that each task writes few files.
    return grouped_buckets(df.repartition(buckets, *keys), name, keys)


def grouped_buckets(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """materialise_buckets of a grouping by the keys, whose tasks hold whole buckets already."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).format("parquet").saveAsTable(table))
    return spark.table(table)
