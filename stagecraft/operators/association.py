"""Rank statistics between a score and citations or labels, with tied values averaged."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.significance import t_two_sided_p
from stagecraft.operators.skew import lookup_counted, running_total
from stagecraft.scratch import materialise


def rank_value(col: str, digits: int | None = None) -> Column:
    """The value to rank by (-0.0 is 0.0), rounded only where the caller gives ``digits``."""
    value = F.col(col).cast("double")
    return (value if digits is None else F.round(value, digits)) + 0.0


def average_ranks(values: DataFrame, value: str, out: str) -> DataFrame:
    """``value, n, out``: one row per distinct value with the mean rank of its rows."""
    counted = materialise(values.groupBy(value).agg(F.count("*").alias("n")), "values")
    placed = running_total(counted, value, "_before", weight=F.col("n"))
    return placed.select(value, "n", (F.col("_before") + (F.col("n") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str, row_id: str,
             digits: int | None = None) -> DataFrame:
    """``spearman_rho, spearman_p, n`` over the rows of df that have both values.

    Values are ranked once per distinct value, then looked up; a value held by a third of
    all rows (0 citations, say) never meets in one task.
    """
    rows = df.select(F.col(row_id).alias("_row"), rank_value(x, digits).alias("_x"),
                     rank_value(y, digits).alias("_y")).where(
        "_x IS NOT NULL AND _y IS NOT NULL")
    for value, rank in (("_x", "_rx"), ("_y", "_ry")):
        ranks = average_ranks(rows.select(value), value, rank)
        rows = lookup_counted(rows, ranks, [value])
    nan = F.lit(math.nan)
    # corr() itself raises on a constant column in ANSI mode.
    rho = F.coalesce(F.try_divide(F.covar_pop("_rx", "_ry"),
                                  F.stddev_pop("_rx") * F.stddev_pop("_ry")), nan)
    result = rows.agg(rho.alias("spearman_rho"), F.count("*").alias("n"))
    r, freedom = F.col("spearman_rho"), F.col("n") - 2
    gap = 1 - r * r
    t = (F.when(F.isnan(r), nan).when(gap <= 0, F.lit(math.inf))
         .otherwise(r * F.sqrt(freedom / F.greatest(gap, F.lit(1e-300)))))
    return result.select("spearman_rho", F.when(
        freedom >= 1, t_two_sided_p(t, freedom)).otherwise(nan).alias("spearman_p"), "n")


def auroc(df: DataFrame, label: str, score: str, digits: int | None = None) -> DataFrame:
    """``auroc``: chance that a positive row outscores a negative one, ties counting half.

    Rank-sum over distinct scores with their positive counts; NaN with one class only. Rows
    without a score or a label do not count.
    """
    scored = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counted = materialise(scored.groupBy(rank_value(score, digits).alias("_s")).agg(
        F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos")), "values")
    placed = running_total(counted, "_s", "_before", weight=F.col("_n"))
    mean_rank = F.col("_before") + (F.col("_n") + 1) / 2.0
    sums = placed.agg(F.sum(F.col("_pos") * mean_rank).alias("_ranks"),
                      F.sum("_pos").alias("_p"), F.sum(F.col("_n") - F.col("_pos")).alias("_q"))
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    return sums.select(F.when(
        (p > 0) & (q > 0), (F.col("_ranks") - p * (p + 1) / 2) / (p * q)
    ).otherwise(F.lit(math.nan)).alias("auroc"))
