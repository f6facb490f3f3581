"""Shuffle, stripe and batch a split the way a trainer reads it.

All order numbers are computed on (split, seq, id) alone; the wide stage texts are
shuffled once, in the final join back on the unique ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.operators.chains import arrival_digest
from stagecraft.operators.skew import running_total


def _join_back(df: DataFrame, numbers: DataFrame) -> DataFrame:
    return df.join(numbers, ["split", "seq"])


def _positions(df: DataFrame) -> DataFrame:
    return running_total(df.select("split", "seq", "id"), "seq", "pos", group=["split"])


def block_shuffle(df: DataFrame, block: int, seed: int) -> DataFrame:
    """Add ``order_pos``: rows shuffled inside consecutive blocks of ``block`` rows."""
    placed = _positions(df).withColumn("_block", F.floor(F.col("pos") / block))
    inside = Window.partitionBy("split", "_block").orderBy(arrival_digest(seed), "seq")
    numbers = placed.select(
        "split", "seq",
        (F.col("_block") * block + F.row_number().over(inside) - 1).alias("order_pos"))
    return _join_back(df, numbers)


def stripe(df: DataFrame, workers: int, shard_rows: int = 2_000) -> DataFrame:
    """Add ``worker``: consecutive shards are dealt to the workers in turn."""
    shard = F.floor(F.col("pos") / shard_rows)
    numbers = _positions(df).select(
        "split", "seq", F.pmod(shard, F.lit(workers)).cast("int").alias("worker"))
    return _join_back(df, numbers)


def worker_order(df: DataFrame, workers: int, block: int, seed: int,
                 shard_rows: int = 2_000) -> DataFrame:
    """Add ``worker`` and ``order_pos``: each worker shuffles blocks of its own shards.

    A worker's shards are consecutive in its own stream, so its row position follows
    from the shard number; only the last shard may be short, and nothing comes after it.
    """
    pos = F.col("pos")
    shard = F.floor(pos / shard_rows)
    placed = _positions(df).withColumn("worker", F.pmod(shard, F.lit(workers)).cast("int"))
    own_pos = F.floor(shard / workers) * shard_rows + pos % shard_rows
    placed = placed.withColumn("_block", F.floor(own_pos / block))
    inside = Window.partitionBy("split", "worker", "_block").orderBy(
        arrival_digest(seed), "seq")
    numbers = placed.select(
        "split", "seq", "worker",
        (F.col("_block") * block + F.row_number().over(inside) - 1).alias("order_pos"))
    return _join_back(df, numbers)


def assign_batches(df: DataFrame, size: int) -> DataFrame:
    """Add ``batch_id`` from ``order_pos``; only the last batch of a split may be short."""
    return df.withColumn("batch_id", F.floor(F.col("order_pos") / size).cast("bigint"))
