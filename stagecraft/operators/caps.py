"""First-N limits by arrival order: per field, per split, and for one sample.

Every limit is turned into a cut: the last ``seq`` it lets through. Cuts are found on
(seq, split, field) alone, and the wide rows are then only filtered, never shuffled or
sorted. ``seq`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.operators.skew import lookup_counted, running_total, with_range

_IS_TRAIN = "split = 'train'"


def field_cuts(keys: DataFrame, cap: int, used: DataFrame | None = None) -> DataFrame:
    """``field, n, cut, room``: rows per field, and the ``seq`` of its last allowed train row.

    ``used`` (``field, n``) holds train rows accepted earlier. ``cut`` is null where the
    field stays within its room. Train rows are counted by field and range of ``seq``; the
    counts tell in which range a field's room ends, and only the rows of that one range are
    ordered. So whatever the cap, a field sends a window one range of its rows at most.
    """
    counts = keys.groupBy("field").agg(F.count("*").alias("n"))
    if used is None:
        rooms = counts.withColumn("room", F.lit(cap).cast("bigint"))
    else:
        earlier = used.select("field", F.col("n").alias("_used"))
        rooms = counts.join(earlier, "field", "left").select("field", "n", F.greatest(
            F.lit(0).cast("bigint"), cap - F.coalesce("_used", F.lit(0))).alias("room"))
    ranged = with_range(keys.where(_IS_TRAIN).select("field", "seq"), "seq", "_range")
    totals = ranged.groupBy("field", "_range").agg(F.count("*").alias("_rows"))
    # At most MAX_RANGES rows a field.
    upto = Window.partitionBy("field").orderBy("_range")
    ends = totals.withColumn("_upto", F.sum("_rows").over(upto)).join(rooms.select("field", "room"), "field")
    before = F.col("_upto") - F.col("_rows")
    last = ends.where((before < F.col("room")) & (F.col("_upto") >= F.col("room"))).select(
        "field", "_range", "_rows", (F.col("room") - before).alias("_need"))
    inside = Window.partitionBy("field", "_range").orderBy("seq")
    cuts = lookup_counted(ranged, last, ["field", "_range"], count="_rows").withColumn(
        "_rank", F.row_number().over(inside)).where(F.col("_rank") == F.col("_need")).select(
        "field", F.col("seq").alias("cut"))
    return rooms.join(cuts, "field", "left").select("field", "n", "cut", "room")


def within_field_cap(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows the field cuts let through; test rows always pass."""
    looked_up = lookup_counted(rows, cuts, ["field"])
    fits = (F.col("room") > 0) & (F.col("cut").isNull() | (F.col("seq") <= F.col("cut")))
    return looked_up.where((F.col("split") != "train") | fits).select(*rows.columns)


def cap_per_field(chains: DataFrame, opts: Options) -> DataFrame:
    """Keep the first ``max_papers_per_field`` train rows of each field (0: all rows)."""
    cap = opts.max_papers_per_field
    if cap <= 0:
        return chains
    keys = chains.select("seq", "split", "field")
    return within_field_cap(chains, field_cuts(keys, cap))


def last_of_first(rows: DataFrame, n: int, order: str = "seq") -> int | None:
    """The order value of the n-th row, or None if there are no more than n rows."""
    placed = running_total(rows.select(order), order, "_pos")
    return placed.where(F.col("_pos") == n - 1).agg(F.max(order)).first()[0]


def head_n(df: DataFrame, n: int | None, order: str = "seq") -> DataFrame:
    """The first n rows by a unique order column (None: all rows)."""
    if n is None:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    last = last_of_first(df, n, order)
    return df if last is None else df.where(F.col(order) <= last)


def split_caps(opts: Options) -> dict[str, int | None]:
    return {"train": opts.max_train_examples, "test": opts.max_test_examples}


def split_condition(keys: DataFrame, rooms: dict[str, int | None]) -> Column | None:
    """Condition on (split, seq) for the first rows of each split; None if nothing is cut.

    It starts with a plain bound on ``seq`` where there is one, which parquet can use.
    """
    cuts: dict[str, int | None] = {}
    for split, room in rooms.items():
        if room is None:
            cuts[split] = None
        elif room <= 0:
            cuts[split] = -1
        else:
            cuts[split] = last_of_first(keys.where(F.col("split") == split), room)
    if all(cut is None for cut in cuts.values()):
        return None
    kept = F.lit(False)
    for split, cut in cuts.items():
        if rooms[split] is not None and rooms[split] <= 0:
            continue
        within = F.lit(True) if cut is None else F.col("seq") <= cut
        kept = kept | ((F.col("split") == split) & within)
    if all(cut is not None for cut in cuts.values()):
        kept = (F.col("seq") <= max(cuts.values())) & kept
    return kept


def cap_per_split(chains: DataFrame, opts: Options) -> DataFrame:
    """Keep the first rows of each split, up to its own cap."""
    kept = split_condition(chains.select("seq", "split"), split_caps(opts))
    return chains if kept is None else chains.where(kept)
