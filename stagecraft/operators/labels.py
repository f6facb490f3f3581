"""Citation labels that hold up under skewed citation counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.text import strip
from stagecraft.operators.skew import lookup_counted, running_total
from stagecraft.scratch import materialise

MIN_FIELD_ROWS = 4


def log_citations(col) -> Column:
    """ln(1 + x) with -inf at -1 and NaN below, where Spark's log1p gives null."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    return (F.when(x == -1, F.lit(-math.inf)).when(x < -1, F.lit(math.nan))
            .otherwise(F.log1p(x)))


def citation_value(opts: Options) -> Column:
    if opts.use_log_citations:
        return log_citations("citations")
    return F.col("citations").cast("double")


def citation_labels(chains: DataFrame, opts: Options) -> DataFrame:
    """Add ``label``: 1 for highly cited rows, by field quantile or by global median.

    Quantiles run over (value, count) pairs after a map-side count, so their input is the
    distinct citation counts of a field, not its rows. The threshold goes back to the rows
    by a lookup that takes hot fields out of the shuffle.
    """
    value = citation_value(opts)
    if opts.label_strategy != "field_quartile":
        counted = chains.groupBy(value.alias("_value")).agg(F.count("*").alias("_n"))
        median = exact_quantile(counted, "_value", "_n", 0.5)
        return chains.withColumn("label", (value > F.lit(median)).cast("int"))
    grouped = chains.withColumn("_field", _field_group())
    thresholds = _field_thresholds(grouped, value, opts.top_quantile)
    labelled = lookup_counted(grouped, thresholds, ["_field"])
    top = F.col("threshold").isNotNull() & (value >= F.col("threshold"))
    return labelled.withColumn("label", top.cast("int")).drop("threshold", "_field")


def exact_quantile(counted: DataFrame, value: str, n: str, quantile: float) -> float | None:
    """The interpolated quantile of weighted values; null values are left out, None without any.

    Running totals over value ranges tell how many rows come before each value, so no task
    sees all of them; the one or two values around the wanted place reach the driver.
    """
    kept = materialise(counted.where(F.col(value).isNotNull()).select(value, n), "counted")
    total = kept.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    if not total:
        return None
    place = quantile * (total - 1)
    low, high = math.floor(place), math.ceil(place)
    placed = running_total(kept, value, "_before", weight=F.col(n))
    inside = [(F.col("_before") <= at) & (F.col("_before") + F.col(n) > at) for at in (low, high)]
    below, above = placed.agg(*[F.max(F.when(i, F.col(value))) for i in inside]).first()
    return below if below == above else below + (above - below) * (place - low)


def _field_group() -> Column:
    """A null or blank field counts as 'unknown'."""
    return F.coalesce(F.nullif(strip(F.col("field")), F.lit("")), F.lit("unknown"))


def _field_thresholds(chains: DataFrame, value: Column, quantile: float) -> DataFrame:
    counted = chains.groupBy("_field", value.alias("_value")).agg(F.count("*").alias("_n"))
    per_field = counted.groupBy("_field").agg(
        F.sum("_n").alias("n"),
        F.percentile("_value", quantile, F.col("_n")).alias("_quantile"))
    return per_field.select("_field", "n", F.when(
        F.col("n") >= MIN_FIELD_ROWS, F.col("_quantile")).alias("threshold"))


def positive_rate(labelled: DataFrame, *by: str) -> DataFrame:
    return labelled.groupBy(*by).agg(F.avg("label").alias("positive_rate"),
                                     F.count("*").alias("n"))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def field_counts(df: DataFrame) -> DataFrame:
    train = df.where(F.col("split") == "train")
    return train.groupBy("field").agg(F.count("*").alias("n"))
