"""Edge losses between predicted and true stage vectors, and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.vectors import dot, squared_distance

EDGE = ["batch_id", "i", "j"]


def edge_loss(pairs: DataFrame, kind: str = "cosine") -> DataFrame:
    """``batch_id, i, j, cos, loss``: batch means per edge.

    cosine: mean of 1 - p.t; mse: mean of the squared distance (2 x cosine for unit
    vectors). ``cos`` is the mean cosine the trivial-edge filter looks at.
    """
    if kind not in ("cosine", "mse"):
        raise ValueError(f"unknown edge loss {kind!r}")
    cosine = dot("pred", "true")
    loss = squared_distance("pred", "true") if kind == "mse" else 1.0 - cosine
    scored = pairs.select(*EDGE, cosine.alias("_cos"), loss.alias("_loss"))
    return scored.groupBy(*EDGE).agg(F.avg("_cos").alias("cos"), F.avg("_loss").alias("loss"))


def drop_trivial_edges(losses: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop (batch, edge) groups whose mean cosine is above the threshold."""
    return losses.where(F.col("cos") <= threshold)


def combined_loss(nll: DataFrame, losses: DataFrame, weight: float) -> DataFrame:
    """``batch_id, loss``: nll plus the weighted mean of the batch's edge losses.

    ``nll`` has one row per batch; a batch without used edges keeps its nll.
    """
    per_batch = losses.groupBy("batch_id").agg(F.avg("loss").alias("_edge_loss"))
    joined = nll.join(per_batch, "batch_id", "left")
    return joined.select("batch_id", (
        F.col("nll") + weight * F.coalesce("_edge_loss", F.lit(0.0))).alias("loss"))


def edges_run(pairs: DataFrame) -> DataFrame:
    """Number of (batch, edge) groups left after dropout, trivial ones included."""
    return pairs.select(*EDGE).distinct().agg(F.count("*").alias("edges_run"))


def surprise(pairs: DataFrame) -> DataFrame:
    """Add ``surprise``: 1 - pred.true, so 0 means exactly as predicted."""
    return pairs.withColumn("surprise", 1.0 - dot("pred", "true"))
