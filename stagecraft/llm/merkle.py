"""A Merkle manifest of a table: a proof for every row, a root for every source and for all.

1. Bitmaps. The doc_ids of a source form a sparse bitmap: one 64-bit word for each 64 ids
   of which at least one occurs, merged by bitwise or (on the map side first). A running
   total of the words' row counts is the popcount directory, so a row's leaf number is the
   directory entry of its word plus the popcount of the lower bits: no leaves are sorted.
2. Slot arrays. Nodes are keyed by (source, number div 3**DEPTH); each key's slots form one
   array, which is reduced DEPTH levels at once. Its tops are the next round's nodes, so
   rounds grow with the logarithm of the largest source. Keys hold at most 3**DEPTH
   nodes whatever the size of a source.
3. Proofs go down the same rounds: the path of a node is its siblings inside its array and
   then the path of the array's top. The path is folded over the row's digest where it is
   made, and only the results leave.

Words that hold more rows than bits (repeated ids) are few; their rows are numbered by
running totals over the leading bits of the leaf, and equal rows by their count.

Defined results: rows of one doc_id are ordered by leaf; a null doc_id stands before all
others and is never tampered with; equal rows are leaves of their own. A null source is a
source of its own, the first. A source's leaf that stands alone is its subroot, a lone
subroot the root; a proof without siblings is the hash of nothing. An empty table has no
rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.operators.skew import lookup_counted, running_total
from stagecraft.scratch import materialise

FANOUT, DEPTH, PIECE = 3, 6, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWEST = -(1 << 63)
_BIT = "cast(_id & 63 as int)"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """doc_id, source key, id as key, leaf, and the leaf after tampering (null: as before)."""
    text = F.col("text").cast("string")
    cut = F.replace(text, F.lit("\n"), F.lit(""))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    row = docs.select(*fields)
    own = digest(*[_framed(F.col(c)) for c in fields])
    forged = digest(*[_framed(cut if c == "text" else F.col(c)) for c in fields])
    return row.select(
        F.col("doc_id").cast("bigint"),
        # Null first, then sources by their bytes.
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("_id"),
        own.alias("leaf"), F.when(tampered, forged).alias("forged"))


def bitmap_directory(rows: DataFrame) -> DataFrame:
    """``tree, _word, bits, n, before``: the non-empty words of each tree's bitmap, their
    rows and the rows before them."""
    words = rows.groupBy("tree", F.shiftright("_id", 6).alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, {_BIT}))").alias("bits"), F.count("*").alias("n"))
    words = materialise(words, "merkle-words")
    return running_total(words, "_word", "before", weight=F.col("n"), group=["tree"])


def numbered(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """Rows of ``leaves`` with ``at``, their number among the leaves of their tree."""
    found = lookup_counted(rows.withColumn("_word", F.shiftright("_id", 6)),
                           directory.withColumn("rows", F.col("n")), ["tree", "_word"])
    single = F.col("rows") == F.bit_count("bits")
    upto = F.col("bits").bitwiseAND(F.expr(f"shiftrightunsigned(-1L, 63 - {_BIT})"))
    keep = ("tree", "doc_id", "leaf", "forged")
    plain = found.where(single).select(
        *keep, (F.col("before") + F.bit_count(upto) - 1).alias("at"))
    return plain.unionByName(_repeated(found.where(~single)).select(*keep, "at"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Numbers where ids repeat: by id and leaf; the same row as often as it occurs."""
    same = ["tree", "_word", "before", "_id", "doc_id", "leaf", "forged"]
    head = F.conv(F.substring("leaf", 1, 14), 16, 10).cast("bigint")
    order = F.col("_id").bitwiseAND(F.lit(63)) * F.lit(1 << 56) + head
    counted = materialise(rows.groupBy(*same).agg(F.count("*").alias("_copies"))
                          .withColumn("_order", order), "merkle-repeated")
    group = ["tree", "_word"]
    starts = running_total(counted.groupBy(*group, "_order").agg(F.sum("_copies").alias("_all")),
                           "_order", "_first", weight=F.col("_all"), group=group)
    tie = Window.partitionBy(*group, "_order").orderBy("_id", "leaf").rowsBetween(
        Window.unboundedPreceding, -1)
    first = counted.withColumn("_tie", F.coalesce(F.sum("_copies").over(tie), F.lit(0))).join(
        starts.drop("_all"), [*group, "_order"])
    zero = F.lit(0).cast("bigint")
    pieces = first.withColumn("_piece", F.explode(F.sequence(
        zero, F.floor((F.col("_copies") - 1) / PIECE).cast("bigint"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.least((F.col("_piece") + 1) * PIECE, F.col("_copies")) - 1
    return pieces.repartition(parts, *group, "leaf", "_piece").withColumn(
        "_copy", F.explode(F.sequence(F.col("_piece") * PIECE, upto))).withColumn(
        "at", F.col("before") + F.col("_first") + F.col("_tie") + F.col("_copy"))


def _next_level(nodes: Column) -> Column:
    """Digests of the runs of FANOUT consecutive nodes."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda run: F.sha2(
        F.array_join(F.slice(nodes, run * FANOUT + 1, FANOUT), ""), 256))


def _levels(size: Column) -> Column:
    """Levels that ``size`` nodes need, DEPTH at most."""
    steps = [F.when(size > FANOUT**k, 1).otherwise(0) for k in range(DEPTH)]
    return sum(steps[1:], steps[0])


def _heights(slots: Column, levels: Column) -> Column:
    """The node arrays of every level, the slots' own first."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.array(slots), lambda tree, k: F.when(
        k < levels, F.concat(tree, F.array(_next_level(F.element_at(tree, -1))))).otherwise(tree))


def reduce_round(nodes: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """One round. ``nodes``: tree, at, node and what else a slot carries; ``sizes``: tree, size,
    a row for each tree. Returns ``tree, block, size, slots, levels, top``."""
    width = FANOUT**DEPTH
    carried = [c for c in nodes.columns if c not in ("tree", "at", "node")]
    slot = F.struct((F.col("at") % width).cast("int").alias("slot"), "node", *carried)
    arrays = nodes.groupBy("tree", F.floor(F.col("at") / width).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(slot), lambda a, b: a["slot"] - b["slot"]).alias("slots"))
    counts = sizes.withColumn("_blocks", F.ceil(F.col("size") / width).cast("bigint"))
    known = lookup_counted(arrays, counts, ["tree"], count="_blocks").withColumn(
        "levels", _levels(F.col("size")))
    heights = _heights(F.col("slots.node"), F.col("levels"))
    return materialise(known.withColumn("top", F.element_at(F.element_at(heights, -1), 1)), name)


def _path(tree: Column, slot: Column, levels: Column) -> Column:
    """Left and right siblings of a slot, level by level."""
    def step(k: Column) -> Column:
        at = F.floor(slot / F.pow(F.lit(float(FANOUT)), k)).cast("int")
        inside, nodes = at % FANOUT, F.element_at(tree, k + 1)
        return F.struct(
            F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("left"),
            F.array_join(F.slice(nodes, at + 2, F.lit(FANOUT - 1) - inside), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(DEPTH - 1)), F.lit(1), levels), step)


def _opened(round_: DataFrame, above: DataFrame, out) -> DataFrame:
    """Rows of a round's slots: ``out(slot, path)`` with the path up to the root. ``above``:
    tree, block, path and what else belongs to the block."""
    both = round_.join(above, ["tree", "block"]).withColumn(
        "_heights", _heights(F.col("slots.node"), F.col("levels")))
    rows = F.transform("slots", lambda s: F.struct(s.alias("s"), F.concat(
        _path(F.col("_heights"), s["slot"], F.col("levels")), F.col("path")).alias("path")))
    carried = [c for c in above.columns if c not in ("tree", "block", "path")]
    return both.select("tree", "block", *carried, F.inline(F.transform(
        rows, lambda r: out(r["s"], r["path"]))))


def build(nodes: DataFrame, sizes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """All rounds over ``nodes``; the last has one block for each tree."""
    rounds, width = [], FANOUT**DEPTH
    while True:
        rounds.append(reduce_round(nodes, sizes, f"merkle-{name}-{len(rounds)}"))
        if largest <= width:
            return rounds
        largest = -(-largest // width)
        sizes = sizes.withColumn("size", F.ceil(F.col("size") / width).cast("bigint"))
        nodes = rounds[-1].select("tree", F.col("block").alias("at"), F.col("top").alias("node"))


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """From the tops' paths to those of the first round's blocks."""
    carried = [c for c in above.columns if c not in ("tree", "block", "path")]
    for round_ in reversed(rounds[1:]):
        width = FANOUT**DEPTH
        opened = _opened(round_, above, lambda s, path: F.struct(s["slot"].alias("_slot"), path.alias("path")))
        above = opened.select("tree", (F.col("block") * width + F.col("_slot")).alias("block"), "path", *carried)
    return above


def _in_order(trees: DataFrame) -> DataFrame:
    """Add ``at``, the place of each tree among all: a total sort, whose partitions are counted."""
    placed = materialise(trees.orderBy("tree").withColumn(
        "_row", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition of the sort.
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "at", F.col("_start") + inside).drop("_part", "_row", "_start")


def manifest(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = materialise(leaves(docs, fields), "merkle-leaves")
    directory = bitmap_directory(rows)
    trees = materialise(directory.groupBy("tree").agg(F.sum("n").alias("size")), "merkle-trees")
    largest = trees.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    count = trees.count()
    nodes = numbered(rows, directory).withColumnRenamed("leaf", "node")
    rounds = build(nodes, trees, largest, "leaves")

    tops = rounds[-1].select("tree", F.col("top").alias("node"))
    # The tree of trees has one key, '', and its blocks are as small as any others.
    upper = _in_order(tops).select(F.lit("").alias("tree"), "at", "node", F.col("tree").alias("of"))
    whole = trees.sparkSession.createDataFrame([("", count)], "tree string, size bigint")
    upper_rounds = build(upper, whole, count, "trees")
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = upper_rounds[-1].select("tree", "block", F.col("top").alias("root"), none.alias("path"))
    over = _opened(upper_rounds[0], _down(upper_rounds, start), lambda s, path: F.struct(
        s["of"].alias("of"), s["node"].alias("subroot"), path.alias("path")))
    start = over.select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("block"),
                        "path", "subroot", "root")

    def result(slot: Column, path: Column) -> Column:
        siblings = F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")
        folded = F.aggregate(path, F.coalesce(slot["forged"], slot["node"]), lambda node, p: F.sha2(
            F.concat(p["left"], node, p["right"]), 256))
        return F.struct(slot["doc_id"].alias("doc_id"), slot["node"].alias("leaf"),
                        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))

    proved = _opened(rounds[0], _down(rounds, start), result)
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
