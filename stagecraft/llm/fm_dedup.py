"""Remove passages of ``WINDOW`` words that occur more than once, by sharded FM-indexes.

Every window of words has a minimizer: the smallest hash of its ``GRAM``-word runs.
Consecutive windows with the same minimizer form a segment. Equal windows have equal
minimizers, so a shard that holds all segments of a minimizer sees every occurrence of
their windows, and each segment need only be searched in its own shard.

1. Segments are counted by minimizer. A minimizer seen once, and once in its text, has no
   repeated window.
2. Segments that occur whole more than once are repeated throughout; equal ones are
   counted together and go on as one.
3. Segments that share a minimizer but differ, or hold it twice, go to shards. A shard's text becomes an
   FM-index: suffix array, Burrows-Wheeler transform, wavelet matrix with bit ranks. Backward
   search runs over all windows at once; a window drops out when fewer than two places
   match, and what lasts over the whole window is reported.
4. The intervals go back to the documents and the words they cover are removed.

A minimizer with more than ``HOT`` different segments is cut into single windows. Those with
the same minimizer and hash are combined; a window without an equal one is not repeated, of
the others two copies each are dealt by their hash, searched, and the answer is joined back
to all. So a shard holds about ``SHARD`` words however often a passage occurs. Words and
segments are compared by 64-bit hashes, segments and single windows by minimizer and digest
together (128 bits).

Defined results: a null text has no words; texts shorter than the window lose nothing;
kept words are joined by one space. Repeated rows are documents of their own, so all their
windows are repeated. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.words import (
    batched, gram_hashes, run_hashes, signed, sliding_min, word_hashes, word_spans)
from stagecraft.scratch import materialise

WINDOW, GRAM, SHARD, HOT = 35, 6, 500_000, 5000


def segments(words: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Minimizers, digests, first windows, numbers of windows of a text's segments, and
    whether the minimizer stands in the text again (a window may then repeat in a segment)."""
    count = len(words) - window + 1
    if count <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    grams = gram_hashes(words, gram)
    least = sliding_min(grams, window - gram + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    sizes = np.diff(np.append(starts, count))
    digests = run_hashes(words, starts, starts + sizes + window - 1)
    grams.sort()
    again = (np.searchsorted(grams, least[starts], "right")
             - np.searchsorted(grams, least[starts], "left") > 1)
    return signed(least[starts]), signed(digests), starts, sizes, again


# ---- FM-index ----------------------------------------------------------------------------

class Bits:
    """A bit vector in 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of any symbol at any place, in one bit vector a level."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` symbols end among those equal to ``symbol``, up to a shift."""
        for k, bits in enumerate(self.levels):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, bits.zeros + ones, at - ones)
        return at


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By doubling; ``ranks`` order the first symbols, separators are all different."""
    n, step = len(ranks), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = ranks[step:] + 1
        keys = ranks * (n + 1) + ahead
        order = np.argsort(keys, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(keys[order][1:] != keys[order][:-1])))
        ranks = np.empty(n, np.int64)
        ranks[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FmIndex:
    """Over several word sequences, each closed by a separator of its own."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        _, codes = np.unique(np.concatenate(sequences), return_inverse=True)
        total = int(sizes.sum()) + len(sizes)
        self.text = np.zeros(total, np.int64)
        separator = np.zeros(total, bool)
        separator[self.starts + sizes] = True
        self.text[~separator] = codes + 1
        ranks = self.text + len(sizes)
        ranks[separator] = np.arange(len(sizes))
        order = suffix_array(ranks)
        self.bwt = WaveletMatrix(self.text[order - 1] * (order > 0))
        counts = np.bincount(self.text)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        symbols = np.arange(len(counts))
        self.zero = self.bwt.place(symbols, np.zeros(len(counts), np.int64))
        self.size = total

    def extend(self, symbol, low, high):
        """One step of backward search."""
        shift = self.first[symbol] - self.zero[symbol]
        return shift + self.bwt.place(symbol, low), shift + self.bwt.place(symbol, high)

    def repeated(self, at: np.ndarray, window: int) -> np.ndarray:
        """Which of the windows that start at ``at`` match in two places or more."""
        left = np.arange(len(at))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.size)
        for k in range(window - 1, -1, -1):
            low, high = self.extend(self.text[at[left] + k], low, high)
            alive = high - low >= 2
            left, low, high = left[alive], low[alive], high[alive]
        out = np.zeros(len(at), bool)
        out[left] = True
        return out


def repeated_ranges(sequences: list[np.ndarray], window: int = WINDOW):
    """For each sequence the word ranges covered by windows found twice or more."""
    index = FmIndex(sequences)
    counts = np.array([max(0, len(s) - window + 1) for s in sequences])
    own = np.repeat(np.arange(len(sequences)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    good = index.repeated(index.starts[own] + within, window)
    own, within = own[good], within[good]
    if not len(own):
        return
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (within[1:] != within[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    for a, b in zip(first, last):
        yield int(own[a]), int(within[a]), int(within[b]) + window


# ---- the job -----------------------------------------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tag"), "text")


def cut(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, minimizer, digest, start, size, loops (0 or 1) of every segment."""
    names = ("doc_id", "tag", "least", "digest", "start", "size", "loops")

    def run(batches):
        for batch in batches:
            ids, tags = batch["doc_id"].to_pylist(), batch["tag"].to_pylist()
            for at in range(0, len(ids), 256):
                parts, rows = [], []
                for i, text in enumerate(batch["text"].slice(at, 256).to_pylist(), at):
                    found = segments(word_hashes((text or "").encode("utf-8", "surrogatepass"))[2], window)
                    parts.append(found)
                    rows += [i] * len(found[0])
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in rows], pa.int64()),
                     pa.array([tags[i] for i in rows], pa.int64()),
                     *(pa.array(c.astype(np.int64)) for c in columns)], names=list(names))

    return keyed(docs).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


_WORDS = pa.schema([("least", pa.int64()), ("digest", pa.int64()), ("words", pa.list_(pa.int64()))])
_WORDS_SQL = "least bigint, digest bigint, words array<bigint>"


def segment_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(minimizer, digest, word hashes) of the wanted segments."""

    def fill(batch):
        for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
            words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[2]
            for s in found:
                own = words[s["start"] : s["start"] + s["size"] + window - 1]
                yield s["least"], s["digest"], signed(own)

    lists = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("start", "size", "least", "digest")).alias("found"))
    joined = keyed(docs).join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))
                       & (F.col("tag") == F.col("_tag"))).select("text", "found")
    return joined.mapInArrow(batched(_WORDS, fill, 1000), _WORDS_SQL)


def hot_words(docs: DataFrame, hot: np.ndarray, window: int) -> DataFrame:
    """(minimizer, digest, word hashes) of the different segments of the hot minimizers; no
    text is moved for them. There are at most 1 / ``HOT`` as many as segments."""
    def fill(batch):
        for text in batch["text"].to_pylist():
            words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[2]
            least, digest, starts, sizes, _ = segments(words, window)
            for i in np.flatnonzero(np.isin(least, hot)):
                yield (least[i], digest[i],
                       signed(words[starts[i] : starts[i] + sizes[i] + window - 1]))

    return docs.select("text").mapInArrow(batched(_WORDS, fill, 1000), _WORDS_SQL
                                          ).dropDuplicates(["least", "digest"])


def window_hashes(words: DataFrame, window: int) -> DataFrame:
    """(minimizer, hash, digest, place in the segment) of every window of the segments."""
    names = ("least", "hash", "digest", "at")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part["words"]
                values, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
                starts = offsets[:-1] - offsets[0]
                counts = np.diff(offsets) - window + 1
                own = np.repeat(np.arange(len(counts)), counts)
                at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                begin = starts[own] + at
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                    part["least"].to_numpy()[own], signed(run_hashes(values, begin, begin + window)),
                    part["digest"].to_numpy()[own], at)], names=list(names))

    return words.mapInArrow(
        run, ", ".join(f"{n} bigint" for n in names))


def hot_ranges(words: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(minimizer, digest, from, to): repeated windows of the hot segments. Equal windows
    are combined first; two of each go to the shard of their hash, however many there are."""
    own = window_hashes(words, window)
    place = F.struct("digest", "at")
    twice = own.groupBy("least", "hash").agg(F.min(place).alias("_low"), F.max(place).alias("_high")
                                             ).where("_low <> _high")
    copies = materialise(twice.select("least", "hash", F.posexplode(F.array("_low", "_high")).alias(
        "copy", "_place")).select("least", "hash", "copy", "_place.*"), "windows")
    shards = max(1, -(-copies.count() * (window + 1) // shard_words))
    sent = copies.groupBy("least", "digest").agg(
        F.collect_list(F.struct("hash", "copy", "at")).alias("sent")).hint("merge")
    dealt = words.join(sent, ["least", "digest"]).select("least", "words", F.explode("sent").alias("_s")).select(
        F.pmod("_s.hash", F.lit(shards)).alias("shard"), "least", F.col("_s.hash").alias("digest"),
        F.col("_s.copy").cast("bigint").alias("at"),
        F.slice("words", F.col("_s.at").cast("int") + 1, window).alias("words"))
    found = search_shards(dealt, window).select("least", F.col("digest").alias("hash")).distinct()
    return own.join(found.hint("merge"), ["least", "hash"]).select(
        "least", "digest", F.col("at").alias("low"), (F.col("at") + window).alias("high"))


def search_shards(words: DataFrame, window: int) -> DataFrame:
    """(minimizer, digest, from, to): repeated word ranges of the segments of each shard."""
    names = ("least", "digest", "low", "high")

    def search(shard: pa.Table) -> pa.Table:
        names_ = ("least", "digest", "at")
        _, once = np.unique(np.stack([shard[c].to_numpy() for c in names_]), axis=1,
                            return_index=True)  # a repeated document brings its segments twice
        shard = shard.take(pa.array(once))
        own = [shard[c].to_numpy() for c in names_]
        flat = pa.concat_arrays(shard["words"].chunks)
        values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
        words_ = [values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
        rows = [(own[0][i], own[1][i], own[2][i] + a, own[2][i] + b)
                for i, a, b in repeated_ranges(words_, window)]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return words.groupBy("shard").applyInArrow(search, ", ".join(f"{n} bigint" for n in names))


def repeated(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD,
             hot: int = HOT) -> DataFrame:
    """(doc_id, tag, from, to): ranges of words covered by windows that occur elsewhere too."""
    seen = cut(docs, window).groupBy("least").agg(
        F.count("*").alias("n"), F.min("digest").alias("_low"), F.max("digest").alias("_high"),
        F.max("loops").alias("_loops"))
    twice = seen.where("n > 1 or _loops = 1").select("least", (
        (F.col("_low") != F.col("_high")) | (F.col("_loops") == 1)).alias("mixed"))
    flagged = materialise(cut(docs, window).drop("loops").join(twice.hint("merge"), "least"),
                          "segments")
    kinds = materialise(flagged.where("mixed").groupBy("least", "digest").agg(
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "tag", "start", "size")).alias("_rep")), "kinds")
    many = kinds.groupBy("least").agg((F.count("*") > hot).alias("hot"),
                                      F.sum(F.col("_rep.size") + window).alias("_words"))
    cold = F.sum(F.when(~F.col("hot"), F.col("_words")))
    total, common = many.agg(F.coalesce(cold, F.lit(0)),
                             F.collect_list(F.when(F.col("hot"), F.col("least")))).first()
    wanted = kinds.join(many.where("not hot").hint("merge"), "least").select(
        "least", "digest", "_rep.*")
    shards = max(1, -(-total // shard_words))
    found = search_shards(segment_words(docs, wanted, window).select(
        F.pmod("least", F.lit(shards)).alias("shard"), "least", "digest",
        F.lit(0).cast("bigint").alias("at"), "words"), window)
    if common:
        words = materialise(hot_words(docs, np.array(common, np.int64), window), "words")
        found = found.unionAll(hot_ranges(words, window, shard_words))
    whole = flagged.join(kinds.where("n > 1").select("least", "digest", F.lit(True).alias("_again"))
                         .hint("merge"), ["least", "digest"], "left").where("_again or not mixed")
    parts = flagged.where("mixed").join(found.hint("merge"), ["least", "digest"])
    return whole.select("doc_id", "tag", F.col("start").alias("low"),
                        (F.col("start") + F.col("size") + window - 1).alias("high")).unionAll(
        parts.select("doc_id", "tag", (F.col("start") + F.col("low")).alias("low"),
                     (F.col("start") + F.col("high")).alias("high")))


def without(text: str | None, ranges) -> tuple[int, int, bytes]:
    """Words, removed words and the kept words joined by one space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, ends = word_spans(data)
    gone = np.zeros(len(starts) + 1, np.int64)
    for r in ranges or ():
        gone[r["low"]] += 1
        gone[r["high"]] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    words = b" ".join(data[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist()))
    return len(starts), len(starts) - len(kept), words


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD,
                   hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.string())])

    def fill(batch):
        for doc_id, text, ranges in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "ranges"))):
            n, removed, kept = without(text, ranges)
            yield (doc_id, n, removed, hashlib.sha256(kept).hexdigest(),
                   kept.decode("utf-8", "surrogatepass"))

    ranges = repeated(docs, window, shard_words, hot).groupBy(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(
        F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = keyed(docs).join(ranges.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))
                              & (F.col("tag") == F.col("_tag")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(
        batched(schema, fill, 500), "doc_id bigint, n_words bigint, n_removed bigint, "
        "kept_sha256 string, kept string")
