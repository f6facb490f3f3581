"""Incremental ingest: new paper files become capped chain shards, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stagecraft.config import Options
from stagecraft.plans.dataset import capped, split_chains
from stagecraft.scratch import materialise
from stagecraft.sources.shards import write_shards

_COUNTS = "split string, field string, n bigint"


def ingest_stream(papers: DataFrame, out: str, checkpoint: str, opts: Options) -> StreamingQuery:
    """Write every available paper once to ``out/chains`` and stop.

    Chains are built statelessly; the caps go on from the counts up to the batch before,
    which that batch wrote. Each micro-batch owns one ``batch_id`` directory that a replay
    overwrites, so a lost executor or restarted query changes nothing; missing counts of
    the batch before are an error. A micro-batch is read once and kept as a table.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, out, opts)

    return (split_chains(papers, opts).writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_ingested(spark: SparkSession, out: str, with_batch: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{out}/chains")
    return rows if with_batch else rows.drop("batch_id")


def _write_batch(batch: DataFrame, batch_id: int, out: str, opts: Options) -> None:
    spark = batch.sparkSession
    done = _counts_before(spark, out, batch_id)
    written = {r["split"]: r["n"] for r in
               done.groupBy("split").agg(F.sum("n").alias("n")).take(2)}
    fields = done.where("split = 'train'").groupBy("field").agg(F.sum("n").alias("n"))
    kept = capped(materialise(batch, "batch"), opts, used_fields=fields, used_splits=written)
    chains = f"{out}/chains/batch_id={batch_id}"
    write_shards(kept, chains, opts)
    added = spark.read.schema(batch.schema).parquet(chains).groupBy("split", "field").agg(
        F.count("*").alias("n"))
    upto = done.unionByName(added).groupBy("split", "field").agg(F.sum("n").alias("n"))
    upto.write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")


def _counts_before(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Rows written by all earlier batches; the ids of a query's batches have no gaps."""
    if batch_id == 0:
        return spark.createDataFrame([], _COUNTS)
    return spark.read.schema(_COUNTS).parquet(f"{out}/counts/batch_id={batch_id - 1}")
