"""Adversarial candidate pools: one true result, its flipped copy, random others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.functions.hashing import digest, draw
from stagecraft.functions.text import flip_findings
from stagecraft.operators.chains import with_context
from stagecraft.scratch import materialise

# Hash prefixes: 4096 tiles of the id circle, 256 slices of one id's rows.
_TILE_DIGITS = 3
_SLICE_DIGITS = 2


def pool_key(df: DataFrame) -> DataFrame:
    return df.withColumn("pool_id", F.col("seq").cast("string"))


def hash_circle(chains: DataFrame, seed: int) -> DataFrame:
    """Place every row on a circle ordered by (md5 of id, id, md5 of seq, seq).

    Returns ``seq, idx`` (place on the circle) and ``after, others``: the first place past
    the rows sharing the row's id, and how many rows have another id. Rows of one id are
    neighbours, so "an other id" is one arc. A hot id is counted before any shuffle and
    its rows are ranked in slices.
    """
    rows = chains.select(
        "id", "seq", digest("seq", seed).alias("_row_hash")).withColumn(
        "_slice", F.substring("_row_hash", 1, _SLICE_DIGITS))
    slices = rows.groupBy("id", "_slice").agg(F.count("*").alias("_n")).withColumn(
        "_id_hash", digest("id", seed)).withColumn(
        "_tile", F.substring("_id_hash", 1, _TILE_DIGITS))

    # At most 4096 tiles: their start places are broadcast and their window is one task.
    tiles = slices.groupBy("_tile").agg(F.sum("_n").alias("_tile_n"))
    earlier_tiles = Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tile_starts = tiles.select("_tile", F.coalesce(
        F.sum("_tile_n").over(earlier_tiles), F.lit(0)).alias("_tile_start"))

    in_tile = Window.partitionBy("_tile").orderBy("_id_hash", "id", "_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    one_id = Window.partitionBy("_tile", "_id_hash", "id")
    total = chains.select(F.count("*")).scalar()
    starts = (slices
              .withColumn("_before", F.coalesce(F.sum("_n").over(in_tile), F.lit(0)))
              .withColumn("_id_before", F.min("_before").over(one_id))
              .withColumn("_id_n", F.sum("_n").over(one_id))
              .join(F.broadcast(tile_starts), "_tile")
              .select("id", "_slice",
                      (F.col("_tile_start") + F.col("_before")).alias("_slice_start"),
                      (F.col("_tile_start") + F.col("_id_before") + F.col("_id_n"))
                      .alias("after"),
                      (total - F.col("_id_n")).alias("others")))
    in_slice = Window.partitionBy("id", "_slice").orderBy("_row_hash", "seq")
    return (rows.withColumn("_local", F.row_number().over(in_slice) - 1)
            .join(starts, ["id", "_slice"])
            .select("seq", (F.col("_slice_start") + F.col("_local")).alias("idx"),
                    "after", "others"))


def random_picks(chains: DataFrame, wanted: int, seed: int) -> DataFrame:
    """``pool_id, cand_seq``: for each row ``wanted`` distinct rows of other ids.

    A row reads consecutive places of the arc of other ids from a random start, so the
    picks never repeat, fall short only when too few other rows exist, and are found by an
    equi-join on the place number.
    """
    circle = materialise(hash_circle(chains, seed), "circle")
    total = chains.select(F.count("*")).scalar()
    count = F.least(F.lit(wanted).cast("bigint"), F.col("others"))
    start = draw(F.lit("pick"), "seq", seed)
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"),
                                         F.greatest(count, F.lit(1)) - 1))
    targets = circle.select(
        F.col("seq").cast("string").alias("pool_id"), "after", "others",
        start.alias("_start"), F.explode(steps).alias("_step"))
    place = F.col("after") + (F.col("_start") % F.col("others") + F.col("_step")) % F.col("others")
    wants = targets.select("pool_id", (place % total).alias("idx"))
    return wants.join(circle.select("idx", F.col("seq").alias("cand_seq")), "idx").select(
        "pool_id", "cand_seq")


def _kinds(seq: str) -> Column:
    """A pool's own two candidates, from the chain's row."""
    def candidate(kind):
        return F.struct(F.lit(kind).alias("kind"), F.col(seq).alias("cand_seq"), F.lit(kind == "true").alias("is_true"))

    return F.inline(F.array(candidate("true"), candidate("flip")))


def pool_places(chains: DataFrame, n_distractors: int, seed: int) -> DataFrame:
    """``pool_id, pos, kind, cand_seq, is_true``: a shuffled candidate list per chain, by the
    chains whose results (or flipped results) the candidates are.

    The flipped result is always there; ``n_distractors - 1`` random results of other ids
    join it. ``pool_id`` is the chain's ``seq``, since ids may repeat.
    """
    candidates = pool_key(chains).select("pool_id", _kinds("seq"))
    if n_distractors > 1:
        candidates = candidates.unionByName(random_picks(chains, n_distractors - 1, seed).select(
            "pool_id", F.lit("random").alias("kind"), "cand_seq", F.lit(False).alias("is_true")))
    mixed = Window.partitionBy("pool_id").orderBy(
        digest("pool_id", "kind", "cand_seq", seed), "kind", "cand_seq")
    return candidates.withColumn("pos", F.row_number().over(mixed) - 1).select(
        "pool_id", "pos", "kind", "cand_seq", "is_true")


def build_pools(chains: DataFrame, n_distractors: int, seed: int) -> DataFrame:
    """``pool_id, pos, kind, text, is_true``: the candidates with their texts."""
    return with_texts(pool_places(chains, n_distractors, seed), chains)


def with_texts(places: DataFrame, chains: DataFrame) -> DataFrame:
    texts = chains.select(F.col("seq").alias("cand_seq"), F.col("result").alias("text"))
    # A result is flipped once, on the one row whose candidate it is.
    text = F.when(F.col("kind") == "flip", flip_findings("text")).otherwise(F.col("text"))
    return places.join(texts, "cand_seq").select("pool_id", "pos", "kind", text.alias("text"), "is_true")


def contexts(chains: DataFrame) -> DataFrame:
    """``pool_id, ctx``: title..experiment of each chain, one row per pool."""
    return with_context(pool_key(chains)).select("pool_id", "ctx")


def shared_pools(chains: DataFrame, n_distractors: int, seed: int) -> DataFrame:
    """Pools with their context on every row, as both scorers see them.

    The scorers take pools and contexts apart, so the long context is not copied per
    candidate; this joined form is for export.
    """
    pools = build_pools(chains, n_distractors, seed)
    return pools.join(contexts(chains), "pool_id").select(
        "pool_id", "ctx", "pos", "kind", "text", "is_true")
