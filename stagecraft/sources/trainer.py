"""Ordered output a trainer reads worker by worker, and the same rows read back in file order.

Rows are range-partitioned by (split, worker, order_pos) and sorted inside a partition, so a
worker's rows lie in consecutive tasks and its files, by name, hold consecutive positions. A
worker opens its own folder alone and reads from the first file to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.operators.ordering import worker_order

_KEY = ["split", "worker"]


def write_worker_files(chains: DataFrame, path: str, opts: Options, seed: int | None = None) -> None:
    """``path/rows/split=S/worker=W/*.parquet`` in reading order, ``path/files`` their index.

    Order numbers are worked out on narrow keys (see worker_order). The texts cross the
    network once to meet their numbers and once to their place; no task holds a worker.
    """
    placed = worker_order(chains, opts.num_workers, opts.shuffle_buffer,
                          opts.seed if seed is None else seed, opts.shard_rows)
    parts = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of ranges: joined ones would make files larger than asked for.
    (placed.repartitionByRange(parts, *_KEY, "order_pos").sortWithinPartitions(*_KEY, "order_pos")
     .write.partitionBy(*_KEY).option("maxRecordsPerFile", opts.shard_rows)
     .mode("overwrite").parquet(f"{path}/rows"))
    _index(chains.sparkSession, path).write.mode("overwrite").parquet(f"{path}/files")


def _with_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the name of their file, as it sorts, and their place in it."""
    name = F.col("_metadata.file_name")
    task = F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint")
    roll = F.regexp_extract(name, r"\.c(\d+)\.", 1).cast("bigint")
    return spark.read.parquet(f"{path}/rows").select(
        "*", name.alias("file"), task.alias("_task"), roll.alias("_roll"),
        F.col("_metadata.row_index").alias("_row"))


def _index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: split, worker, file, number of the file, first position, rows.

    The window runs over files, of which a worker has one for each shard of rows.
    """
    files = _with_file(spark, path).groupBy(*_KEY, "file", "_task", "_roll").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*_KEY).orderBy("_task", "_roll")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        *_KEY, "file", (F.row_number().over(order) - 1).alias("number"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_pos"), "n")


def read_worker(spark: SparkSession, path: str, split: str, worker: int) -> DataFrame:
    """One worker's rows; the files of the others are pruned by their folders."""
    return spark.read.parquet(f"{path}/rows").where(
        (F.col("split") == split) & (F.col("worker") == worker))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``file_pos``, the place at which their worker reads them."""
    files = spark.read.parquet(f"{path}/files").select(*_KEY, "file", "first_pos")
    return _with_file(spark, path).join(files, [*_KEY, "file"]).withColumn(
        "file_pos", F.col("first_pos") + F.col("_row")).drop("file", "_task", "_roll", "_row", "first_pos")
