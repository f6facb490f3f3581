"""Order and lookup building blocks that stay balanced when one key is hot.

None of them collects a group: totals are partial aggregates, running totals are cut
into value ranges, and only tables with a proven row bound are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.scratch import materialise

MAX_RANGES = 2048
# A key is "hot" from 1/HOT_SHARE of all rows on, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
SALTS = 32
# A lookup within both bounds is broadcast whole.
BROADCAST_ROWS = 50_000
BROADCAST_KEY_BYTES = 16 << 20


def salt_of(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def with_range(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add a range number that never decreases as numeric ``key`` grows.

    The cut points are approximate quantiles (one pass over ``key`` alone). They only
    balance the ranges: any cut points give the same running totals.
    """
    parts = min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts: list[float] = []
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        keys = df.select(F.col(key).cast("double").alias(key)).where(~F.isnan(key))
        cuts = sorted(set(keys.approxQuantile(key, probs, 0.25 / parts)))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    as_double = df.withColumn("_key", F.col(key).cast("double"))
    ranged = Bucketizer(splits=edges, inputCol="_key", outputCol=out,
                        handleInvalid="keep").transform(as_double)
    return ranged.withColumn(out, F.col(out).cast("int")).drop("_key")


def running_total(df: DataFrame, key: str, out: str, *, weight: Column | None = None,
                  group: Sequence[str] = ()) -> DataFrame:
    """Add the total weight of all rows of the group with a smaller ``key``.

    ``key`` must be unique within a group. Rows are summed inside one value range of one
    group at a time; the table of range totals that links the ranges has at most
    MAX_RANGES rows per group.
    """
    weight = F.lit(1) if weight is None else weight
    ranged = with_range(df.withColumn("_w", weight.cast("bigint")), key, "_range")
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_w").alias("_sum"))
    before_range = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range",
                           F.coalesce(F.sum("_sum").over(before_range), F.lit(0))
                           .alias("_start"))
    before_row = Window.partitionBy(*group, "_range").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(before_row), F.lit(0)))
    return (local.join(starts, [*group, "_range"])
            .withColumn(out, F.col("_start") + F.col("_local"))
            .drop("_w", "_range", "_local", "_start"))


def lookup_counted(big: DataFrame, lookup: DataFrame, keys: Sequence[str],
                   count: str = "n", *, stored: bool = False) -> DataFrame:
    """Join ``big`` to ``lookup``, whose rows are the distinct keys of ``big`` (null among
    them) with their row counts in ``count``. Rows without a partner go, null keys meet
    each other; both whatever the size of the lookup.

    The lookup is written once (a job) and its size checked. A small one is broadcast. For
    a large one, ``big`` is read twice: rows of hot keys (at most HOT_SHARE keys) are
    answered from a broadcast and never shuffled, all others go through a shuffled join.

    A ``stored`` lookup is a table already and is not written again; its keys hold no null,
    so that its buckets (see materialise_buckets) serve the join.
    """
    keys = list(keys)
    if not stored:
        lookup = materialise(lookup, "lookup")
    payload = [c for c in lookup.columns if c not in keys and c != count]
    key_bytes = F.octet_length(F.concat_ws("", *[F.col(k).cast("string") for k in keys]))
    size, key_size, total = lookup.agg(
        F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in (key_bytes, F.col(count))]).first()
    found = lookup.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *payload, F.col(count).alias("_count"))
    same = [F.col(k) == F.col(f"_key_{k}") if stored else F.col(k).eqNullSafe(F.col(f"_key_{k}"))
            for k in keys]
    wanted = [*big.columns, *payload]
    if size <= BROADCAST_ROWS and key_size <= BROADCAST_KEY_BYTES:
        return big.join(F.broadcast(found), same).select(*wanted)
    is_hot = F.col("_count") * HOT_SHARE >= total
    hot, cold = found.where(is_hot), found.where(~is_hot)
    if stored:
        cold = cold.hint("merge")  # on its buckets; the other side's size is not known before
    cold_rows = big.join(F.broadcast(hot.drop(*payload)), same, "left_anti").join(cold, same)
    return big.join(F.broadcast(hot), same).select(*wanted).unionAll(cold_rows.select(*wanted))
