"""Read raw paper records, as a table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stagecraft.config import Options


def configured_columns(df: DataFrame, opts: Options) -> DataFrame:
    """Only the configured columns that exist, so the scan reads nothing else."""
    wanted = [column for _, column in opts.stage_columns]
    wanted += [opts.id_column, opts.year_column, opts.fallback_year_column,
               opts.citation_column, opts.field_column, opts.seq_column]
    return df.select(*[c for c in wanted if c in df.columns])


def read_papers(spark: SparkSession, path: str, opts: Options, fmt: str = "parquet") -> DataFrame:
    return configured_columns(spark.read.format(fmt).load(path), opts)


def read_papers_stream(spark: SparkSession, path: str, schema: StructType, opts: Options,
                       fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return configured_columns(reader.load(path), opts)
