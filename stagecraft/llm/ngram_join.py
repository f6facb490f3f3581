"""Exact Jaccard self-join on word n-grams, and its connected components.

A document is the set of its distinct n-gram hashes; documents with equal sets are one
node. The join loses no link:

1. Bands of set size and parts. Two sets with similarity t or more differ in few n-grams;
   cut into one part more than that (by n-gram hash), they agree on a whole part. Each node
   is listed under the digests of its parts, for its own band of sizes and the one below.
   Nodes met under no common digest are not linked.
2. Hubs. In each list the node with the most copies is verified against the others (after
   the bound of 3 on their points), so most groups of near copies are connected by as many
   pairs as they have members.
3. Count-vector R-tree. N-grams are hashed into ``DIMS`` groups; the group counts of a set
   are its point. Lists that still hold several components get a packed R-tree; pairs of
   tree nodes are pruned when they lie in one component or when the sum of the smaller
   coordinates of their bounding corners cannot reach the overlap that t asks for. The
   pairs left are verified on the sets.

Lists are streamed from a sorted shuffle of (digest, node, copies) rows, copies combined
before. Lists above ``TILE`` are joined in tiles, so no task holds more than two tiles.
Components come from label propagation with pointer jumps over tables in the shared folder.

Defined results: a text of fewer words than n is one n-gram; one without words (or null)
has an empty set and is linked with nothing. component_id is the smallest doc_id in reach;
null ids count as largest, a component of null ids alone is null. Repeated rows give
repeated results. N-grams, parts and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm.words import batched, gram_hashes, mix, run_hashes, signed, word_hashes
from stagecraft.scratch import materialise

DIMS, WIDTH, FANOUT, TILE = 256, 8, 16, 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the lower-cased words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    _, _, words = word_hashes(data)
    if len(words) < n:
        return run_hashes(words, np.array([0]), np.array([len(words)])) if len(words) else words
    return np.unique(gram_hashes(words, n))


def node_id(grams: np.ndarray) -> int | None:
    """One number for the set; none for the empty set."""
    if not len(grams):
        return None
    total = np.add.reduce(mix(grams), dtype=np.uint64) + np.uint64(len(grams))
    return int(signed(mix(np.array([total], np.uint64)))[0])


class Bands:
    """Size bands for a similarity of ``percent`` %, and the number of parts of each.

    Partners of a set of band k that are at least as large lie in band k or k + 1.
    """

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1, 2]

    def of(self, size: int) -> int:
        edges = self.edges
        while edges[-1] <= size:
            edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(edges, size, "right")) - 1

    def most(self, band: int) -> int:
        """The most n-grams in which two sets differ if the smaller one is in the band."""
        self.of(self.edges[-1]) if band + 1 >= len(self.edges) else None
        small = self.edges[band + 1] - 1
        both = small + small * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent)


def part_digests(grams: np.ndarray, band: int, most: int) -> np.ndarray:
    """Digests of the parts of the set, tied to band and place of the part.

    There are more parts than n-grams may differ. If more than ``most`` parts are not
    empty, one of those agrees with a partner's, and empty parts need not be listed.
    """
    parts = most + 1 + -(-most // 8)
    own = mix(grams + np.uint64(0xA5A5A5A5))
    place = (own >> np.uint64(20)) % np.uint64(parts)
    place = place.astype(np.int64)
    out = np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)
    for shift in (0, 22, 44):  # sums of 22-bit pieces are exact in doubles
        piece = ((own >> np.uint64(shift)) & np.uint64((1 << 22) - 1)).astype(np.float64)
        total = np.bincount(place, weights=piece, minlength=parts).astype(np.uint64)
        out = mix(out + total + np.uint64(1))
    full = np.bincount(place, minlength=parts) > 0
    return out[full] if full.sum() > most else out


def heads(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, hash of the text, number of distinct n-grams, node."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", "n_shingles", "node")])

    def fill(batch):
        for doc_id, tag, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "tag", "text"))):
            grams = gram_set(text, n)
            yield doc_id, tag, len(grams), node_id(grams)

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tag"), "text"
                       ).mapInArrow(batched(schema, fill), "doc_id bigint, tag bigint, "
                                    "n_shingles bigint, node bigint")


def listed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(part digest, node, copies); copies in one batch are one row."""
    schema = pa.schema([("part", pa.int64()), ("node", pa.int64()), ("copies", pa.int64())])

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            seen: dict[int, tuple[np.ndarray, int]] = {}
            for text in batch["text"].to_pylist():
                grams = gram_set(text, n)
                node = node_id(grams)
                if node in seen:
                    seen[node] = (seen[node][0], seen[node][1] + 1)
                elif node is not None:
                    band = bands.of(len(grams))
                    digests = [part_digests(grams, b, bands.most(b))
                               for b in (band, band - 1) if b >= 0 and bands.most(b) > 0]
                    seen[node] = (np.concatenate(digests) if digests else grams[:0], 1)
            sizes = [len(d) for d, _ in seen.values()]
            if sum(sizes):
                for at in range(0, len(sizes), 256):
                    held = list(seen.items())[at : at + 256]
                    long = [len(d) for _, (d, _) in held]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(signed(np.concatenate([d for _, (d, _) in held]))),
                        pa.array(np.repeat(np.array([k for k, _ in held], np.int64), long)),
                        pa.array(np.repeat(np.array([c for _, (_, c) in held], np.int64), long))],
                        schema=schema)

    return docs.select("text").mapInArrow(run, "part bigint, node bigint, copies bigint")


def lists(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(part, node, hub) of every digest that several nodes share."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed(docs, n, percent).repartition(parts, "part")
    members = dealt.groupBy("part", "node").agg(F.sum("copies").alias("copies"))
    whole = Window.partitionBy("part")
    marked = members.withColumns({"_top": F.max(F.struct("copies", "node")).over(whole),
                                  "_kinds": F.count("*").over(whole)})
    return marked.where("_kinds > 1").select("part", "node", F.col("_top.node").alias("hub"))


def packed_point(grams: np.ndarray) -> bytes:
    """The group counts, one byte each after a byte that says how often they were halved
    (rounded up, so that bounds still hold) to fit."""
    counts, halved = np.bincount((mix(grams) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS), 0
    while counts.max() > 255:
        counts, halved = (counts + 1) // 2, halved + 1
    return bytes([halved]) + counts.astype(np.uint8).tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(-1, DIMS + 1).astype(np.int32)
    return raw[:, 1:] << raw[:, :1]


def sets_of(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """node, size, grams and point of the nodes in ``reps`` (node, rep: an id that has it)."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("grams", pa.list_(pa.int64())),
                        ("point", pa.binary())])

    def run(batches):
        seen: set[int] = set()  # rows of one id meet in one task

        def fill(batch):
            for node, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist()):
                grams = gram_set(text, n) if node not in seen else None
                if grams is not None and node_id(grams) == node:
                    seen.add(node)
                    yield node, len(grams), signed(grams), packed_point(grams)

        yield from batched(schema, fill, 200)(batches)

    wanted = docs.select(F.col("doc_id").cast("bigint"), "text").join(
        reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    return wanted.mapInArrow(run, "node bigint, size bigint, grams array<bigint>, point binary")


def within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow the similarity; the sets are not moved for it."""
    both = pairs
    for side in "ab":
        own = sets.select(F.col("node").alias(side), F.col("size").alias(f"_size_{side}"),
                          F.col("point").alias(f"_point_{side}"))
        both = both.join(own.hint("merge"), side)

    def run(batches):
        for batch in batches:
            overlap = np.minimum(*(unpacked(batch[f"_point_{x}"].to_pylist()) for x in "ab")).sum(axis=1)
            least = _needed(*(batch[f"_size_{x}"].to_numpy() for x in "ab"), percent)
            yield batch.select(["a", "b"]).filter(pa.array(overlap >= least))

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    both = pairs
    for side in "ab":
        own = sets.select(F.col("node").alias(side), F.col("grams").alias(f"_{side}"))
        both = both.join(own.hint("merge"), side)
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return both.where(common.cast("bigint") * 100 >= union.cast("bigint") * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest node in reach."""
    edges = materialise(links.select("a", "b").unionAll(links.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(
            F.min("label").alias("_near"))
        near = labels.join(seen.hint("merge"), F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("_was"), F.least("label", "_near").alias("label"))
        ahead = labels.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        jumped = materialise(near.join(ahead.hint("merge"), F.col("label") == F.col("_at")).select(
            "node", "_was", F.least("label", "_far").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> _was").isEmpty():
            return labels


# ---- the R-tree --------------------------------------------------------------------------

def _needed(size_a, size_b, percent):
    return np.ceil((size_a + size_b) * percent / (100 + percent) - 1e-9)


def tree_levels(points, sizes, marks):
    """Packed levels from the points up: largest corner, smallest size, mark (-1: several)."""
    levels = [(points, sizes, marks)]
    while len(levels[-1][1]) > 1:
        corner, least, mark = levels[-1]
        at = np.arange(0, len(least), FANOUT)
        low, high = np.minimum.reduceat(mark, at), np.maximum.reduceat(mark, at)
        levels.append((np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at),
                       np.where(low == high, low, -1)))
    return levels


def close_pairs(points: np.ndarray, sizes: np.ndarray, marks: np.ndarray, percent: int):
    """Pairs of points of different marks whose summed coordinate minima reach the overlap."""
    sums = np.add.reduceat(points, np.arange(0, points.shape[1], WIDTH), axis=1)
    order = np.lexsort((sums[:, 0], sizes, marks))
    levels = tree_levels(sums[order], sizes[order], marks[order])
    a = b = np.zeros(1, np.int64)
    for corner, least, mark in reversed(levels):
        kept_a, kept_b = [], []
        for at in range(0, len(a), 1 << 18):
            i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            apart = (mark[i] != mark[j]) | (mark[i] < 0)
            i, j = i[apart], j[apart]
            bound = np.zeros(len(i), np.int64)
            for d in range(corner.shape[1]):
                bound += np.minimum(corner[i, d], corner[j, d])
            good = bound >= _needed(least[i], least[j], percent)
            kept_a.append(i[good])
            kept_b.append(j[good])
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        if len(least) == len(sizes):
            break
        below = len(levels[[len(x[1]) for x in levels].index(len(least)) - 1][1])
        step = np.arange(FANOUT)
        i = (a[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
        j = (b[:, None, None] * FANOUT + 0 * step[None, :, None] + step[None, None, :]).ravel()
        fits = (i < below) & (j < below) & (i <= j)
        a, b = i[fits], j[fits]
    real = a != b
    a, b = order[a[real]], order[b[real]]
    close = [np.zeros(0, bool)]
    for at in range(0, len(a), 1 << 12):
        i, j = a[at : at + (1 << 12)], b[at : at + (1 << 12)]
        close.append(np.minimum(points[i], points[j]).sum(axis=1) >= _needed(sizes[i], sizes[j], percent))
    close = np.concatenate(close)
    return a[close], b[close]


def tree_join(lists_: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) from the lists that hold nodes of several components."""
    label = F.coalesce("label", "node").alias("label")
    marked = lists_.select("part", "node").join(labels.hint("merge"), "node", "left").select(
        "part", "node", label)
    open_ = marked.groupBy("part").agg(F.min("label").alias("_low"), F.max("label").alias("_high"),
                                       F.count("*").alias("_n")).where("_low <> _high")
    tiles = F.ceil(F.col("_n") / TILE).cast("bigint")
    own = F.pmod(F.xxhash64("node"), F.col("_tiles"))
    facing = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_tiles") - 1),
                         lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    members = marked.join(open_.select("part", tiles.alias("_tiles")).hint("merge"), "part")
    points = sets.select("node", "size", "point")
    full = members.select("part", "node", "label", F.explode(facing).alias("_t")).select(
        "part", "_t.i", "_t.j", "node", "label").join(points.hint("merge"), "node")
    count = int(lists_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(count, "part", "i", "j").sortWithinPartitions("part", "i", "j", "node")

    def pairs(rows):
        nodes = np.concatenate([r[0] for r in rows])
        if len(nodes) < 2:
            return
        labels_ = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)[1]
        sizes = np.concatenate([r[2] for r in rows])
        i, j = close_pairs(np.concatenate([r[3] for r in rows]), sizes, labels_, percent)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(nodes[i], nodes[j])), pa.array(np.maximum(nodes[i], nodes[j]))],
                names=["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("part", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            columns = (batch["node"].to_numpy(), batch["label"].to_numpy(), batch["size"].to_numpy(),
                       unpacked(batch["point"].to_pylist()))
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                if key is None or (keys[start] != key).any():
                    if held:
                        yield from pairs(held)
                    held, key = [], keys[start]
                held.append(tuple(c[start:end] for c in columns))
        if held:
            yield from pairs(held)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def pair_order() -> list[Column]:
    return [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]


def links(docs: DataFrame, n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(heads, links): what each document is, and links between nodes that connect every
    component (all those between nodes that the hubs' links leave apart, among them)."""
    head = materialise(heads(docs, n), "heads")
    shared = materialise(lists(docs, n, percent), "lists")
    involved = shared.select("node").distinct()
    reps = head.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")).join(
        involved.hint("merge"), "node")
    sets = materialise(sets_of(docs, reps, n), "sets")
    star = shared.where("node <> hub").select(*pair_order()).distinct()
    first = materialise(verified(within_bound(star, sets, percent), sets, percent), "links")
    rest = tree_join(shared, components(first), sets, percent)
    second = materialise(verified(rest, sets, percent), "links")
    return head, first.unionAll(second)


def grouped(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, and hash of the text, node and the component's label
    of each row (both null for the empty set)."""
    head, found = links(docs, n, percent)
    reps = head.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    named = reps.join(components(found).hint("merge"), "node", "left").select(
        "node", "rep", F.coalesce("label", "node").alias("label"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = named.join(lowest.hint("merge"), "label").select(
        F.col("node").alias("_node"), "label", "component_id")
    return head.join(of_node.hint("merge"), F.col("node") == F.col("_node"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"), "tag", "node", "label")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest doc_id, null ids
    last, of rows with the same id the one with the smallest hash of its text. Ids do not
    make components: unlinked texts stay, whether they share an id or have none. Texts
    with the empty set are linked with nothing; of equal rows of them one stays."""
    tag, kept_id, kept_tag = (_free(docs, name) for name in ("_tag", "_kept_id", "_kept_tag"))
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "tag"))
    kept = grouped(docs, n, percent).groupBy("label", alone.alias("_alone")).agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("_none"), "doc_id", "tag")).alias("_first")).select(
        F.col("_first.doc_id").alias(kept_id), F.col("_first.tag").alias(kept_tag))
    rows = docs.withColumn(tag, F.xxhash64("text")).join(
        kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(kept_id))
        & (F.col(tag) == F.col(kept_tag)), "left_semi")
    return rows.dropDuplicates(["doc_id", tag]).drop(tag)
