"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

Texts are lower-cased and cut into ``\\w+`` tokens. A training text is queried passage by
passage: overlapping windows of twice the longest item (``STRIDE`` at least), so every item
lies whole inside some window. Scores are shares of the score an item has against itself.
The index keeps a posting list a term (items in order of length, with the share the term adds)
and, for every ``IN_BLOCK`` items of that order, the largest share in each list's block.
A passage sums the block maxima of its terms' lists; blocks below ``LEAST`` are dead. On the
others it runs WAND: cursors stand on the lists in item order, the pivot is the first item at
which the terms' largest shares reach ``LEAST``, cursors before it leap to it, and past dead
blocks to the next live one; an item on which all of them meet is scored exactly. All items
above the threshold come back, none is dropped by rank. A hit counts if the passage holds
``OVERLAP`` of the item's five-word shingles, and half of those of its question and of its
answer. A question ends at the last question mark, or after two thirds of the words.

An index holds about ``PER_INDEX`` items and is built from those alone; ``PER_PASS`` of them
are broadcast and asked in one pass over the documents, whose texts are cut into tokens once.
Both are bounds that do not depend on the table: a benchmark of more items than their
product (65,536) is a stated query set run pass after pass.

Defined results: null or empty texts and items without tokens match nothing; an item of
fewer than five words counts as one shingle; equal items all match; repeated rows are
judged alike; an empty benchmark gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.llm.shipped import Shipped
from stagecraft.llm.words import batched
from stagecraft.scratch import materialise

K1, B, LEAST, OVERLAP, PART, SHINGLE = 1.2, 0.75, 0.5, 0.8, 0.5, 5
IN_BLOCK, PER_INDEX, PER_PASS, STRIDE = 4, 512, 128, 64
AT_ONCE = 256  # passages whose blocks are bounded together
_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_words(text: str) -> int:
    """How many of the item's words are its question."""
    ask, sign, rest = text.rpartition("?")
    if sign and tokens(rest) and tokens(ask):
        return len(tokens(ask))
    return -(-2 * len(tokens(text)) // 3)


@dataclass
class Item:
    item_id: int
    words: list[str]
    question: int


@dataclass
class Postings:
    """Lists end to end, one a term: ``places`` rising, ``shares`` beside them."""

    ends: np.ndarray  # terms + 1 offsets
    places: np.ndarray
    shares: np.ndarray

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every entry of the terms' lists: which of the terms, and where it is."""
        first, size = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        whose = np.repeat(np.arange(len(terms)), size)
        return whose, np.arange(len(whose)) + np.repeat(first - (np.cumsum(size) - size), size)


@dataclass
class Index:
    vocabulary: dict[str, int]
    items: list[Item]
    entries: Postings       # by item
    blocks: Postings        # by block of items: the most the term adds in it
    most: np.ndarray        # by term: the most it adds to any item
    stride: int

    @property
    def weights(self) -> np.ndarray:
        """The shares as an items x terms matrix, for looking at small indexes."""
        out = np.zeros((len(self.items), max(1, len(self.vocabulary))))
        whose, at = self.entries.of(np.arange(len(self.vocabulary)))
        out[self.entries.places[at], whose] = self.entries.shares[at]
        return out

    def search(self, words: list[str], least: float = LEAST):
        """(item, share, first word of the passage) of every passage and item above ``least``."""
        known = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        last = max(0, len(words) - 1) // self.stride
        for first in range(0, last + 1, AT_ONCE):
            yield from self._search(known, first, min(first + AT_ONCE, last + 1), least)

    def _search(self, known: np.ndarray, first: int, end: int, least: float):
        """The passages from ``first`` to ``end``: passage k has the words of parts k and k + 1."""
        part = known[first * self.stride : (end + 1) * self.stride]
        at = np.flatnonzero(part >= 0)
        if not len(at):
            return
        term, place = part[at], at // self.stride
        size = len(self.vocabulary)
        keys = np.unique(np.concatenate([place * size + term, (place[place > 0] - 1) * size + term[place > 0]]))
        keys = keys[: np.searchsorted(keys, (end - first) * size)]
        passage, term = keys // size, keys % size
        n_blocks = -(-len(self.items) // IN_BLOCK)
        whose, entry = self.blocks.of(term)
        limit = np.bincount(passage[whose] * n_blocks + self.blocks.places[entry],
                            self.blocks.shares[entry], (end - first) * n_blocks)
        live = limit.reshape(-1, n_blocks) >= least - 1e-6
        starts = np.searchsorted(passage, np.arange(end - first + 1))
        for row in np.flatnonzero(live.any(axis=1)).tolist():
            for item, share in self._wand(term[starts[row] : starts[row + 1]],
                                          np.flatnonzero(live[row]).tolist(), least):
                yield self.items[item], share, (first + row) * self.stride

    def _wand(self, terms: np.ndarray, live: list[int], least: float) -> Iterator[tuple[int, float]]:
        """Items of live blocks whose share from the terms reaches ``least``, in order."""
        lists = []
        for t in terms.tolist():
            a, b = self.entries.ends[t : t + 2].tolist()
            places = self.entries.places[a:b].tolist()
            lists.append([places[0], 0, places, a, float(self.most[t])])  # where the cursor stands first

        def leap(cursors, item):
            for cursor in cursors:
                if cursor[0] < item:
                    cursor[1] = k = bisect_left(cursor[2], item, cursor[1])
                    cursor[0] = cursor[2][k] if k < len(cursor[2]) else len(self.items)

        while True:
            lists = sorted((x for x in lists if x[0] < len(self.items)), key=lambda x: x[0])
            bound, pivot = 0.0, None
            for k, cursor in enumerate(lists):
                bound += cursor[4]
                if bound >= least - 1e-6:
                    pivot = cursor[0]
                    break
            if pivot is None:
                return
            block = bisect_left(live, pivot // IN_BLOCK)
            if block == len(live):
                return
            if live[block] != pivot // IN_BLOCK:
                leap(lists, live[block] * IN_BLOCK)
            elif lists[0][0] < pivot:
                leap(lists[:k], pivot)
            else:
                on = [x for x in lists if x[0] == pivot]
                share = float(sum(self.entries.shares[x[3] + x[1]] for x in on))
                if share >= least - 1e-6:
                    yield pivot, share
                leap(on, pivot + 1)

    def verified(self, words: list[str], least: float = LEAST, overlap: float = OVERLAP):
        """{item_id: (share, overlap, question overlap, answer overlap)} of the items in a text."""
        out = {}
        for item, share, start in self.search(words, least):
            passage = words[start : start + 2 * self.stride]
            found = []
            for part in (item.words, item.words[: item.question], item.words[item.question :]):
                want = shingles(part)
                have = shingles(passage, min(SHINGLE, len(part))) if part else set()
                found.append(len(want & have) / len(want) if want else 1.0)
            if found[0] >= overlap and min(found[1:]) >= PART:
                out[item.item_id] = max(out.get(item.item_id, (0.0,)), (share, *found))
        return out


def build(rows: list[tuple[int, str, list[str], list[int]]], n_items: int, mean: float) -> Index:
    """rows: item_id, text, tokens, document frequency of each token."""
    vocabulary: dict[str, int] = {}
    items, shares = [], []
    for item_id, text, words, dfs in sorted(rows, key=lambda r: (len(r[2]), r[0] is None, r[0], r[1])):
        weight, norm = {}, K1 * (1 - B + B * len(words) / mean)
        for word, df in zip(words, dfs):
            weight[word] = np.log1p((n_items - df + 0.5) / (df + 0.5))
        for word, tf in Counter(words).items():
            weight[word] *= tf * (K1 + 1) / (tf + norm)
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in weight], np.int64)
        own = np.array(list(weight.values()))
        shares.append((ids, own / own.sum()))
        items.append(Item(item_id, words, question_words(text)))
    sizes = [len(ids) for ids, _ in shares]
    term = np.concatenate([ids for ids, _ in shares] or [np.empty(0, np.int64)])
    item = np.repeat(np.arange(len(items)), sizes)
    order = np.lexsort((item, term))
    term, item = term[order], item[order]
    share = np.concatenate([own for _, own in shares] or [np.empty(0)])[order]
    every = np.arange(len(vocabulary) + 1)
    entries = Postings(np.searchsorted(term, every), item, share)
    cell = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(item // IN_BLOCK, prepend=-1))
    blocks = Postings(np.searchsorted(term[cell], every), item[cell] // IN_BLOCK,
                      np.maximum.reduceat(share, cell) if len(cell) else share)
    most = np.maximum.reduceat(share, entries.ends[:-1]) if len(share) else share
    longest = max((len(i.words) for i in items), default=0)
    return Index(vocabulary, items, entries, blocks, most, max(STRIDE, longest))


def indexes(benchmark: DataFrame, per_index: int = PER_INDEX):
    """Index after index over all items, none above ``per_index`` of them by much."""
    schema = pa.schema([("item_id", pa.int64()), ("text", pa.string()),
                        ("words", pa.list_(pa.string()))])

    def fill(batch):
        for item_id, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()):
            if words := tokens(text):
                yield item_id, text, words

    items = benchmark.select(F.col("item_id").cast("bigint"), "text").mapInArrow(
        batched(schema, fill), "item_id bigint, text string, words array<string>")
    n, length = items.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not n:
        return
    term = items.select(F.explode(F.array_distinct("words")).alias("word"))
    df = term.groupBy("word").agg(F.count("*").alias("df"))
    shards = -(-n // per_index)
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    places = keyed.select("shard", "item_id", "text", F.posexplode("words").alias("at", "word"))
    rows = materialise(places.join(df, "word").groupBy("shard", "item_id", "text").agg(
        F.sort_array(F.collect_list(F.struct("at", "word", "df"))).alias("words")), "test-items")
    for shard in range(shards):
        got = []
        for row in rows.where(F.col("shard") == shard).toLocalIterator():
            seen = {w["at"]: w for w in row["words"]}  # equal rows are one item
            words = [seen[i] for i in sorted(seen)]
            got.append((row["item_id"], row["text"], [w["word"] for w in words],
                        [w["df"] for w in words]))
        if got:
            yield build(got, n, length)


def passes(spark: SparkSession, benchmark: DataFrame) -> Iterator[list[Shipped]]:
    """The indexes, shipped, as many as one pass over the documents asks."""
    made = (Shipped(spark, index) for index in indexes(benchmark))
    while some := list(islice(made, PER_PASS)):
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST,
                 overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, share of the item's own
    score, overlaps. Documents are read in place, nothing of them is shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *(
        (c, pa.float64()) for c in ("share", "overlap", "question_overlap", "answer_overlap"))])
    text_schema = ("doc_id bigint, item_id bigint, share double, overlap double, "
                   "question_overlap double, answer_overlap double")
    out = docs.sparkSession.createDataFrame([], text_schema)
    for shared in passes(docs.sparkSession, benchmark):
        def fill(batch, shared=shared):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = tokens(text)
                for index in shared:
                    for item_id, found in index.value.verified(words, least, overlap).items():
                        yield doc_id, item_id, *found

        out = out.unionAll(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            batched(schema, fill), text_schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns kept, in which no test item is found."""
    for shared in passes(docs.sparkSession, benchmark):
        def run(batches, shared=shared):
            for batch in batches:
                clean = [not any(index.value.verified(words) for index in shared)
                         for words in map(tokens, batch["text"].to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
