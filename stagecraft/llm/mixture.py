"""Mix sources to target weights: a plan of packed blocks, in DataFrame functions alone.

The words of each source, in doc_id order, are packed into blocks of ``BLOCK`` words. A
source with target t, size s and b blocks fills round(t * b / s) slots of the mix, so at
most three times b. A pseudorandom permutation of all slots lays them out over output
shards: the source counts of a shard are multinomial draws, conditioned on totals that
meet the targets. Slot j of a source reads block p(j mod b), p being another permutation
for each source and round, so no block is read more often than any other by over one. Slots and
blocks meet in an equi-join on (source, block).

No source is held in one task: offsets are summed inside ranges of doc_id, slots are made
in pieces of ``PIECE`` and dealt by piece, and the join key spreads a source over its
blocks. One task sees a row per source (weights, targets) and a row per source and range.

Defined results: a null text has no words; a document without words is taken 0 times. A
null source is a source of its own, last in order. Rows with the same doc_id are documents
of their own, ordered by the hash of their text. Empty input, empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm.order import order_key, tie
from stagecraft.operators.skew import with_range
from stagecraft.scratch import materialise

BLOCK, SHARD_SLOTS, PIECE, WEIGHTS, MOST = 128, 4096, 4096, (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def _shuffled(at: Column, width: Column, height: Column, key: Sequence[Column]) -> Column:
    """Four rounds on the two digits of ``at`` in a width x height grid: a bijection."""
    left, right = F.floor(at / height).cast("bigint"), F.pmod(at, height)
    for k in range(0, 4, 2):
        left = F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(k), right), width), width)
        right = F.pmod(right + F.pmod(F.xxhash64(*key, F.lit(k + 1), left), height), height)
    return left * height + right


def permuted(at: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends ``at``.

    The grid is at most its width larger than n; places outside are walked on from, at
    most as often as there are such places.
    """
    width = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    height = F.floor((n + width - 1) / width).cast("bigint")
    first = _shuffled(at, width, height, key)
    walked = F.aggregate(F.sequence(F.lit(1).cast("bigint"), width), first, lambda x, _: F.when(
        x >= n, _shuffled(x, width, height, key)).otherwise(x))
    return F.when(first >= n, walked).otherwise(first)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and what orders rows of the same id."""
    return docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        tie("text").alias("_tie"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): number, target, blocks are left to the caller.

    Sources in order of how soon they reach ``most`` times their size are capped as long
    as their share of what is left is above it; the rest share what the capped leave.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("number", F.row_number().over(every).cast("bigint") - 1)
    named = named.withColumn("_w", F.element_at(
        F.array(*[F.lit(w).cast("bigint") for w in weights]),
        (F.col("number") % len(weights) + 1).cast("int")))
    soonest = Window.orderBy(F.col("source_size") / F.col("_w"), "number")
    before, whole = (soonest.rowsBetween(Window.unboundedPreceding, x)
                     for x in (-1, Window.unboundedFollowing))

    def total(what, over):
        return F.coalesce(F.sum(what).over(over), F.lit(0))

    left = named.withColumns({
        "_words": total("source_size", whole) - most * total("source_size", before),
        "_weight": total("_w", whole) - total("_w", before)})
    capped = left.withColumn("_full", (
        most * F.col("source_size").cast("double") * F.col("_weight")
        <= F.col("_w").cast("double") * F.col("_words")))
    shared = capped.withColumns({
        "_rest": total("source_size", whole) - total(
            F.when(F.col("_full"), most * F.col("source_size")), whole),
        "_open": total("_w", whole) - total(F.when(F.col("_full"), F.col("_w")), whole)})
    return shared.select("source", "source_size", "number", F.when(
        F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(
        F.col("_w").cast("double") * F.col("_rest") / F.col("_open")).alias("target"))


def placed(base: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS,
           most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Rows of ``sized`` with their source's number, target and their first word's offset;
    and the sources with their numbers of blocks and slots."""
    ranged = with_range(base.withColumn("_at", order_key("doc_id", "_tie")), "_at",
                        "_range").drop("_at")
    totals = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    sources = totals.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    slots = F.when(blocks > 0, F.round(
        F.col("target") * blocks / F.col("source_size")).cast("bigint")).otherwise(F.lit(0))
    sources = materialise(targets(sources, weights, most).withColumns(
        {"blocks": blocks, "slots": F.least(slots, most * blocks)}), "mix-sources")
    by_range = Window.partitionBy("source").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(by_range), F.lit(0)))
    other = sources.select(F.col("source").alias("_s"), "source_size", "number", "target")
    starts = starts.join(other, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), "_start", "source_size",
        "number", "target")
    by_row = Window.partitionBy("source", "_range").orderBy(
        F.col("doc_id").asc_nulls_last(), "_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_local", F.coalesce(F.sum("size").over(by_row), F.lit(0)))
    rows = inner.join(starts, F.col("source").eqNullSafe(F.col("_s"))
                      & (F.col("_range") == F.col("_r"))).withColumn(
        "offset", F.col("_start") + F.col("_local"))
    return rows.drop("_range", "_local", "_s", "_r", "_start"), sources


def slot_plan(sources: DataFrame, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the mix: shard, place in it, source number, round and block."""
    order = Window.orderBy("number")
    first = F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    every = F.sum("slots").over(order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    pieces = sources.withColumns({"_first": first, "_all": every}).where("slots > 0").select(
        "number", "blocks", "slots", "_first", "_all",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(
            (F.col("slots") - 1) / PIECE).cast("bigint"))).alias("_piece"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = F.explode(F.sequence(F.col("_piece") * PIECE,
                             F.least((F.col("_piece") + 1) * PIECE, F.col("slots")) - 1))
    slots = pieces.repartition(parts, "number", "_piece").select("*", j.alias("_j"))
    again = F.floor(F.col("_j") / F.col("blocks")).cast("bigint")
    place = permuted(F.col("_first") + F.col("_j"), F.col("_all"), F.lit(seed), F.lit(-1))
    return slots.select(
        "number", again.alias("round"), place.alias("_place"),
        permuted(F.pmod(F.col("_j"), F.col("blocks")), F.col("blocks"), F.lit(seed),
                 F.col("number"), again).alias("block")).select(
        F.floor(F.col("_place") / shard_slots).cast("bigint").alias("shard"),
        F.pmod("_place", F.lit(shard_slots)).alias("place"), "number", "round", "block")


def shard_counts(plan: DataFrame) -> DataFrame:
    """How many slots each shard drew of each source."""
    return plan.groupBy("shard", "number").agg(F.count("*").alias("slots"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block it reaches into; offsets name the document."""
    some = rows.where("size > 0")
    low = F.floor(F.col("offset") / block).cast("bigint")
    high = F.floor((F.col("offset") + F.col("size") - 1) / block).cast("bigint")
    reach = some.select("*", F.explode(F.sequence(low, high)).alias("block"))
    start = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    return reach.withColumns({"_from": start - F.col("offset"), "words": end - start})


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, weights: Sequence[int] = WEIGHTS,
        most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    rows, sources = placed(materialise(sized(docs), "mix-sizes"), block, weights, most)
    rows = materialise(rows, "mix-rows")
    reads = slot_plan(sources, seed).groupBy("number", "block").agg(F.count("*").alias("_n"))
    used = pieces(rows.select("number", "offset", "size"), block).join(
        reads.hint("merge"), ["number", "block"]).groupBy("number", "offset").agg(
        F.sum(F.col("words") * F.col("_n")).alias("taken"))
    some = rows.where("size > 0").join(used.hint("merge"), ["number", "offset"], "left")
    out = ("doc_id", "source", "size", "source_size", "target")
    return some.select(*out, F.coalesce("taken", F.lit(0)).alias("taken")).unionAll(
        rows.where("size = 0").select(*out, F.lit(0).cast("bigint").alias("taken")))


def mixed_blocks(docs: DataFrame, seed: int = 1, block: int = BLOCK,
                 weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: shard, place, source, doc_ids and text of each block read."""
    rows, sources = placed(materialise(sized(docs), "mix-sizes"), block, weights, most)
    cut = pieces(rows, block).join(
        docs.select(F.col("doc_id").alias("_id"), tie("text").alias("_t"),
                    F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("_words"))
        .dropDuplicates(["_id", "_t"]),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")))
    part = F.struct("offset", "doc_id", F.slice(
        "_words", (F.col("_from") + 1).cast("int"), F.col("words").cast("int")).alias("words"))
    packed = cut.groupBy("number", "source", "block").agg(
        F.sort_array(F.collect_list(part)).alias("_parts")).select(
        "number", "source", "block", F.col("_parts.doc_id").alias("doc_ids"),
        F.array_join(F.flatten(F.col("_parts.words")), " ").alias("text"))
    return slot_plan(sources, seed).join(packed.hint("merge"), ["number", "block"]).select(
        "shard", "place", "source", "block", "doc_ids", "text")
