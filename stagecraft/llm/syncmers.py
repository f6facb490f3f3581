"""Document fingerprints from closed syncmers.

Every window of ``K`` code points is looked at; it is an anchor if the smallest of its
inner ``S``-code-point substrings (by hash) lies at its first or last place. Whether a
window is chosen depends on its own content alone, so two texts that share a passage
share the anchors inside it, wherever it stands. A fingerprint holds the ``KEPT`` smallest
distinct anchor hashes, 8 hex digits each, in the order in which they first stand in the
text. Two fingerprints are matched by position: of the anchors they share, the longest chain
that keeps the order in both texts counts. Likeness is that chain's share of the smallest
hashes of both together: it estimates the Jaccard similarity of the anchor sets for texts
that agree in order, and falls where passages have changed places.

Defined results: a null text counts as empty; the empty text has the empty fingerprint,
which is like itself (1.0) and unlike any other (0.0). A text without an anchor (shorter
than about 2 K) has one hash, that of the whole text. Equal texts have equal fingerprints.
Documents are ordered by doc_id, null ids last, rows with the same id by a hash of their
text, then the text; the document after the last is the first, so a lone document follows
itself. Ranges are cut from (doc_id, hash), so many rows of one id, or of none, are dealt
to many tasks; only rows equal in both stay together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm.order import order_key, tie
from stagecraft.llm.words import (
    batched, code_points, gram_hashes, mix, run_hashes, signed, sliding_min)
from stagecraft.operators.skew import with_range

K, S, KEPT = 12, 5, 64


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text."""
    inner = gram_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), s)
    width = k - s + 1
    if len(inner) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding_min(inner, width)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    whole = np.zeros(len(at), np.uint64)
    for offset in sorted({*range(0, k - s, s), k - s}):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + inner[at + offset]
    return at, mix(whole)


def fingerprint(text: str, k: int = K, s: int = S, kept: int = KEPT) -> np.ndarray:
    """The smallest distinct anchor hashes in the order of their first places."""
    if not text:
        return np.empty(0, np.uint32)
    codes = code_points(text)
    _, found = anchors(codes, k, s)
    if not len(found):
        found = run_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), np.array([0]),
                           np.array([len(codes)]))
    short = (found >> np.uint64(32)).astype(np.uint32)
    part = short
    if len(short) > 4 * kept:  # what is left of the smallest after repeats go is checked below
        part = np.partition(short, 4 * kept - 1)[: 4 * kept]
    least = np.unique(part)[:kept]
    if len(least) < kept and len(part) < len(short):
        least = np.unique(short)[:kept]
    placed = short[short <= least[-1]]
    _, first = np.unique(placed, return_index=True)
    return placed[np.sort(first)]


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of the longest common chain in the smallest hashes of both fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:kept]
    place = {h: i for i, h in enumerate(b.tolist()) if h <= union[-1]}
    return chain_length([place[h] for h in a.tolist() if h in place]) / len(union)


def chain_length(places: list[int]) -> int:
    """Length of the longest rising subsequence of different numbers."""
    ends: list[int] = []  # the smallest end of a chain of each length
    for at in places:
        k = bisect_left(ends, at)
        ends[k : k + 1] = [at]
    return len(ends)


def syncmer_anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Every anchor of every text: doc_id, position (code points), hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("hash", pa.int64())])

    def fill(batch):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            at, found = anchors(code_points(text or ""), k, s)
            yield from ((doc_id, p, h) for p, h in zip(at.tolist(), signed(found).tolist()))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        batched(schema, fill, 100_000), "doc_id bigint, position bigint, hash bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """Deal the documents into ranges of (doc_id, hash) and sort them; the first document of
    each range also goes, marked ``ahead``, behind the last one of the range before it.

    Texts cross the network once. The table of ranges has at most as many rows as there
    are shuffle partitions.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", tie("text").alias("hash"))
    docs = with_range(docs.withColumn("_at", order_key("doc_id", "hash")), "_at", "_range")
    order = Window.orderBy("_range")  # one row a range
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    firsts = docs.groupBy("_range").agg(F.min(where).alias("_first"))
    last = F.max("_range").over(order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("_range", "_first",
                           F.coalesce(F.lag("_range").over(order), last).alias("_before"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    goes = F.when(where.eqNullSafe(F.col("_first")), F.array(
        F.struct(F.col("_range").alias("part"), F.lit(False).alias("ahead")),
        F.struct(F.col("_before").alias("part"), F.lit(True).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("_range").alias("part"), F.lit(False).alias("ahead"))))
    dealt = docs.join(F.broadcast(firsts), "_range").select(
        F.explode(goes).alias("_to"), "doc_id", "text", "hash").select(
        "_to.*", "doc_id", "text", "hash")
    return dealt.repartition(parts, "part").sortWithinPartitions(
        "part", "ahead", F.col("doc_id").asc_nulls_last(), "hash",
        F.col("text").asc_nulls_first()).drop("hash")


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compare(doc_id, text, mark, following, next_mark):
    changed = edited(text, following)
    other = mark if changed == text else fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, as_text(mark), as_text(other),
            likeness(mark, other), likeness(mark, next_mark))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, with their likeness to each
    other and to the next document. One row per input row."""
    def run(batches):
        held, part, closed = None, None, False
        for batch in batches:
            rows = []
            for to, ahead, doc_id, text in zip(*(batch[c].to_pylist() for c in (
                    "part", "ahead", "doc_id", "text"))):
                if to != part:
                    held, part, closed = None, to, False
                if closed:
                    continue
                text = text or ""
                mark = fingerprint(text)
                if held is not None:
                    rows.append(_compare(*held, text, mark))
                held, closed = (doc_id, text, mark), ahead
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return with_next(docs).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
