"""Embedding-collapse diagnostics in one pass over the vectors, without an N x N matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.functions.vectors import dot

MIN_VECTORS = 4
_MERGE_GROUPS = 64


def mean_pairwise_cos(df: DataFrame, vector: str = "vec") -> DataFrame:
    """Mean cosine over all ordered pairs of distinct rows of unit vectors.

    (|sum v|^2 - sum |v|^2) / (n (n - 1)); NaN below four rows.
    """
    # normL2 holds the root of the sum of squares per dimension.
    stats = df.agg(Summarizer.metrics("sum", "count", "normL2").summary(
        array_to_vector(F.col(vector).cast("array<double>"))).alias("_s"))
    parts = stats.select(
        F.col("_s.count").alias("n"),
        vector_to_array("_s.sum").alias("_sum"),
        vector_to_array("_s.normL2").alias("_root"))
    n = F.col("n").cast("double")
    off_diagonal = dot("_sum", "_sum") - dot("_root", "_root")
    return parts.select(F.when(
        n >= MIN_VECTORS, F.try_divide(off_diagonal, n * (n - 1))
    ).otherwise(F.lit(math.nan)).alias("mean_pairwise_cos"))


def _gram(df: DataFrame, vector: str) -> DataFrame:
    """``n, gram``: one row, the d x d Gram matrix of all vectors, flat.

    Every task folds its rows into one matrix (NumPy, Arrow batches); the matrices are summed
    in two levels, so no task merges more than one per mapper group.
    """
    # Nested functions are pickled whole, so executors need no installed package.
    def partial_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, gram = 0, None
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["v"].to_numpy()).astype(float)
                gram = rows.T @ rows if gram is None else gram + rows.T @ rows
                n += len(rows)
        if gram is not None:
            yield pd.DataFrame({"n": [n], "gram": [gram.ravel()]})

    def merge(grouped) -> DataFrame:
        return grouped.agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram"))

    partial = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(
        partial_gram, "n bigint, gram array<double>")
    group = F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS))
    return merge(merge(partial.withColumn("_group", group).groupBy("_group")).groupBy())


def gram_cells(df: DataFrame, vector: str = "vec") -> DataFrame:
    """``i, j, value``: the cells of the Gram matrix whose eigenvalues give the rank, from 0."""
    cells = _gram(df, vector).select(
        F.sqrt(F.size("gram").cast("double")).cast("int").alias("_d"), F.posexplode("gram").alias("_at", "value"))
    return cells.select(F.floor(F.col("_at") / F.col("_d")).cast("int").alias("i"),
                        (F.col("_at") % F.col("_d")).alias("j"), "value")


def effective_rank(df: DataFrame, vector: str = "vec") -> DataFrame:
    """exp of the entropy of the normalised singular values; NaN below four rows.

    The singular values are the roots of the eigenvalues of the Gram matrix (see gram_cells),
    of which one task sees d x d numbers.
    """
    def entropy_rank(grams: pd.Series) -> pd.Series:
        def one(flat):
            side = math.isqrt(len(flat))
            eigenvalues = np.linalg.eigvalsh(np.asarray(flat, dtype=float).reshape(side, side))
            singular = np.sqrt(np.clip(eigenvalues, 0.0, None))
            share = singular / singular.sum()
            return float(np.exp(-(share * np.log(share + 1e-12)).sum()))

        return grams.map(one, na_action="ignore").astype("float64")

    merged = _gram(df, vector)
    rank = F.pandas_udf(entropy_rank, "double")
    return merged.select(F.when(F.col("n") >= MIN_VECTORS, rank("gram")).otherwise(
        F.lit(math.nan)).alias("effective_rank"))
