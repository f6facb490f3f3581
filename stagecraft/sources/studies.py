"""Study results out: JSON tables and plot series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_study(df: DataFrame, directory: str, name: str) -> str:
    path = f"{directory.rstrip('/')}/study_{name}"
    df.write.mode("overwrite").json(path)
    return path


def plot_series(summary: DataFrame, x: str, y: str) -> DataFrame:
    """The (x, y) points of a curve over numeric variants, sorted by x."""
    return summary.select(F.col(x).cast("double").alias("x"), F.col(y).alias("y")).orderBy("x")
