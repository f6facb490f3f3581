"""A corpus bigram model with add-alpha smoothing, and perplexity from its token losses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.text import full_text, tokens
from stagecraft.operators.skew import lookup_counted
from stagecraft.scratch import grouped_buckets, materialise, materialise_buckets, splits_up_to

# A task keeps the distinct pairs of the files it reads until all are counted: so many bytes of them.
SPLIT_BYTES = 64 << 20


@dataclass(frozen=True)
class BigramModel:
    """``counts``: v, w, n, in buckets of (v, w).  ``firsts``: v, n (as first of a pair),
    pairs (distinct ones).  ``vocabulary``: token.  ``pairs``: see there."""

    counts: DataFrame
    firsts: DataFrame
    vocabulary: DataFrame

    @cached_property
    def pairs(self) -> DataFrame:
        """v, w, n, first_n (n of all pairs with the same v), in buckets of (v, w): a known
        pair is one row to read. Made when first asked for."""
        firsts = self.firsts.select("v", F.col("pairs").alias("n"), F.col("n").alias("first_n"))
        return materialise_buckets(lookup_counted(self.counts, firsts, ["v"], stored=True), "pairs", ["v", "w"])

    @cached_property
    def size(self) -> int:
        """Distinct tokens and one for all unknown ones."""
        return self.vocabulary.count() + 1


def _adjacent(words: str) -> Column:
    # Pair each token with its successor inside the row; no window or shuffle is needed.
    n = F.size(words)
    return F.arrays_zip(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("v"),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("w"))


def bigrams(chains: DataFrame) -> DataFrame:
    """``seq, v, w``: adjacent tokens of the whole full text."""
    return chains.select("seq", tokens(full_text()).alias("_words")).select(
        "seq", F.inline(_adjacent("_words"))).toDF("seq", "v", "w")


def fit_bigram(train: DataFrame) -> BigramModel:
    """Count tokens and adjacent pairs; every count is combined on the map side.

    The counts are written once, in buckets of (v, w), as they come out of the grouping: a
    join on the pair moves only the other side. The first words are counted from those.
    """
    with splits_up_to(train.sparkSession, SPLIT_BYTES):
        counts = grouped_buckets(bigrams(train).groupBy("v", "w").agg(F.count("*").alias("n")), "counts", ["v", "w"])
        firsts = materialise(counts.groupBy("v").agg(
            F.sum("n").alias("n"), F.count("*").alias("pairs")), "firsts")
    # Every token but the last of its document is the first word of some pair.
    words = tokens(full_text())
    last = train.select(F.element_at(words, F.size(words)).alias("token")).distinct()
    return BigramModel(counts, firsts, firsts.select(F.col("v").alias("token")).unionAll(last).distinct())


def _nll(model: BigramModel, opts: Options, pair_n: Column, first_n: Column) -> Column:
    return -F.log((pair_n + opts.smoothing) / (first_n + opts.smoothing * model.size))


def _known(model: BigramModel, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (grouped by v, w) with ``pair_n``, null where the model has none; written."""
    known = wanted.join(model.counts.select("v", "w", F.col("n").alias("pair_n")).hint("merge"), ["v", "w"], "left")
    with splits_up_to(wanted.sparkSession, SPLIT_BYTES):
        return materialise(known, "known")


def _losses(model: BigramModel, wanted: DataFrame, opts: Options) -> DataFrame:
    """The rows of ``wanted`` (grouped by v, w) with their ``nll``."""
    known = _known(model, wanted)
    firsts = known.groupBy("v").agg(F.count("*").alias("n")).join(
        model.firsts.select("v", F.col("n").alias("first_n")), "v", "left")
    return lookup_counted(known, firsts, ["v"]).select(*wanted.columns, _nll(
        model, opts, F.coalesce("pair_n", F.lit(0)), F.coalesce("first_n", F.lit(0))).alias("nll"))


def corpus_perplexity(model: BigramModel, test: DataFrame, opts: Options) -> DataFrame:
    """``perplexity, avg_nll`` of whole documents, each counting the same.

    A pair weighs the sum of its shares of the documents it stands in, combined on the map
    side, so losses meet distinct pairs only and no token crosses the network with its
    document. A pair's loss is a part of its first word less a part of its own, so the first
    parts are weighed for each distinct first word and never brought to the pairs.
    """
    words = test.select(tokens(full_text()).alias("_words")).where(F.size("_words") > 1)
    share = 1.0 / (F.size("_words") - 1)
    seen = words.select(share.alias("_share"), F.inline(_adjacent("_words"))).toDF("_share", "v", "w")
    wanted = seen.groupBy("v", "w").agg(F.sum("_share").alias("_weight"))
    known = _known(model, wanted)
    own = known.agg(
        F.sum(F.col("_weight") * F.log(F.coalesce("pair_n", F.lit(0)) + opts.smoothing)).alias("_own"),
        F.sum("_weight").alias("_docs"))
    firsts = known.groupBy("v").agg(F.sum("_weight").alias("_weight")).join(
        model.firsts.select("v", F.col("n").alias("first_n")), "v", "left").agg(F.sum(
            F.col("_weight") * F.log(F.coalesce("first_n", F.lit(0)) + opts.smoothing * model.size)).alias("_first"))
    # The weights of a document's pairs sum to one, so all weights sum to the documents.
    mean = F.try_divide(F.col("_first") - F.col("_own"), F.col("_docs"))
    return own.crossJoin(firsts).select(F.coalesce(mean, F.lit(0.0)).alias("avg_nll")
                                        ).select(F.exp("avg_nll").alias("perplexity"), "avg_nll")


def score_bigram(model: BigramModel, test: DataFrame, opts: Options) -> DataFrame:
    """``seq, nll``: mean of -ln P(w|v) over each document's adjacent pairs.

    Probabilities are looked up once per distinct test pair. Frequent first words and
    frequent pairs are kept out of the shuffled joins (see lookup_counted).
    """
    seen = bigrams(test)
    wanted = seen.groupBy("v", "w").agg(F.count("*").alias("n"))
    losses = materialise_buckets(_losses(model, wanted, opts), "losses", ["v", "w"])
    return _document_means(seen, losses)


def score_fitted(model: BigramModel, train: DataFrame, opts: Options) -> DataFrame:
    """``seq, nll`` of the documents that the model was fitted on.

    All their pairs are in the model, so nothing is counted or joined first: the model's own
    buckets answer, and only the documents' pairs move. Counting a pair's repeats inside its
    document first would save 6 % of the moved rows of ordinary prose and costs more.
    """
    nll = _nll(model, opts, F.col("n"), F.col("first_n"))
    return _document_means(bigrams(train), model.pairs.select("v", "w", "n", nll.alias("nll")))


def _document_means(seen: DataFrame, losses: DataFrame) -> DataFrame:
    scored = lookup_counted(seen, losses, ["v", "w"], stored=True)
    return scored.groupBy("seq").agg(F.avg("nll").alias("nll"))


def perplexity(scored: DataFrame) -> DataFrame:
    """``perplexity, avg_nll``: each document counts the same; 1.0 and 0.0 without any."""
    mean = scored.agg(F.coalesce(F.avg("nll"), F.lit(0.0)).alias("avg_nll"))
    return mean.select(F.exp("avg_nll").alias("perplexity"), "avg_nll")
