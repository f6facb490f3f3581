"""All metric families over one test split, and the training-side losses of one epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.text import flip_findings
from stagecraft.functions.vectors import Encoder, encode, predict_stage, with_once
from stagecraft.operators import association, health, labels, lm, losses, pools, retrieval
from stagecraft.operators.caps import head_n
from stagecraft.operators.chains import (
    counted_stages, edge_dropout, edge_pairs, edges_for, prefix_counts, with_context,
)
from stagecraft.operators.ordering import assign_batches, block_shuffle
from stagecraft.scratch import materialise


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt to all cores; tables with enough tasks stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def vector_store(chains: DataFrame, opts: Options, encoder: Encoder | None = None) -> DataFrame:
    """``seq, pred, own, flip``: the vectors of each chain's context, result and flipped
    result, each text encoded once; written, since several metrics read them."""
    texts = with_context(_spread(chains.select("seq", "title", "hypothesis", "method", "experiment", "result")))
    flipped = with_once(texts.select("seq", "ctx", "result"), flip_findings("result").alias("_flipped"))
    vectors = predict_stage(flipped, "ctx", "pred", opts, encoder=encoder)
    vectors = encode(vectors, "result", "own", opts, encoder=encoder)
    vectors = encode(vectors, "_flipped", "flip", opts, encoder=encoder)
    return materialise(vectors.select("seq", "pred", "own", "flip"), "vectors")


def _long(metrics: DataFrame, family: str, *names: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(family).alias("family"), F.lit(n).alias("metric"),
                              F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.inline(rows))


def surprise_rows(test: DataFrame, store: DataFrame) -> DataFrame:
    """``seq, field, citations, surprise``: how unexpected each result was."""
    scored = losses.surprise(store.select("seq", "pred", F.col("own").alias("true")))
    return test.select("seq", "field", "citations").join(scored.select("seq", "surprise"), "seq")


def evaluate_all(train: DataFrame, test: DataFrame, opts: Options, *,
                 encoder: Encoder | None = None, with_rank: bool = True,
                 digits: int | None = None) -> DataFrame:
    """``family, metric, value`` for perplexity, embedding health, F1 and F2.

    Pools are built once and read by both scorers, every text is encoded once (see
    vector_store). Pass shard tables (see build_or_reuse), so that the families re-read
    columns rather than rebuild chains.
    """
    parts = []
    if opts.eval_perplexity:
        scored = lm.corpus_perplexity(lm.fit_bigram(train),
                                      head_n(test, opts.perplexity_eval_examples), opts)
        parts.append(_long(scored, "perplexity", "perplexity", "avg_nll"))

    store = vector_store(test, opts, encoder)
    vectors = head_n(store.select("seq", F.col("own").alias("vec")), opts.collapse_eval_examples)
    parts.append(_long(health.mean_pairwise_cos(vectors), "embedding_health",
                       "mean_pairwise_cos"))
    if with_rank:
        parts.append(_long(health.effective_rank(vectors), "embedding_health",
                           "effective_rank"))

    places = materialise(pools.pool_places(test, opts.n_distractors, opts.seed), "pools")
    dense = retrieval.rank_candidates(retrieval.dense_from_store(places, store), digits)
    parts.append(_long(retrieval.retrieval_metrics(dense), "F1_model",
                       "recall_at_1", "recall_at_5", "mrr"))
    lexical = retrieval.bm25_scores(pools.with_texts(places, test), pools.contexts(test))
    parts.append(_long(retrieval.bm25_recall(lexical, digits),
                       "F1_bm25", "recall_at_1"))

    rows = materialise(surprise_rows(test, store), "surprise")
    labelled = labels.citation_labels(rows, opts)
    parts.append(_long(association.spearman(rows, "surprise", "citations", "seq", digits), "F2",
                       "spearman_rho", "spearman_p"))
    parts.append(_long(association.auroc(labelled, "label", "surprise", digits), "F2", "auroc"))
    parts.append(_long(labels.positive_rate(labelled), "F2", "positive_rate"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def training_losses(train: DataFrame, opts: Options, *,
                    encoder: Encoder | None = None) -> DataFrame:
    """``batch_id, nll, loss``: one epoch's batch losses under the given options.

    Edges are dropped before they are encoded (see batch_edge_losses).
    """
    ordered = block_shuffle(train.select("seq", "id", "split"), opts.shuffle_buffer, opts.seed)
    batches = materialise(
        assign_batches(ordered, opts.batch_size).select("seq", "batch_id"), "batches")
    scored = lm.score_fitted(lm.fit_bigram(train), train, opts)
    nll = batches.join(scored, "seq").groupBy("batch_id").agg(F.avg("nll").alias("nll"))
    if not opts.edge_loss_enabled:
        return nll.select("batch_id", "nll", F.col("nll").alias("loss"))
    per_edge = batch_edge_losses(_spread(train).join(batches, "seq"), opts, encoder=encoder)
    if opts.use_trivial_edge_filter:
        per_edge = losses.drop_trivial_edges(per_edge, opts.trivial_edge_cosine_threshold)
    total = losses.combined_loss(nll, per_edge, opts.edge_loss_weight)
    return nll.join(total, "batch_id").select("batch_id", "nll", "loss")


def batch_edge_losses(batched: DataFrame, opts: Options, *,
                      encoder: Encoder | None = None) -> DataFrame:
    """Losses of each (batch, edge) left after dropout.

    The default encoder's counts add up, so each stage is hashed once, however many contexts
    and targets it is part of. A learned encoder reads the texts of the edges kept.
    """
    counted = encoder is None
    if counted:
        pairs = edge_pairs(counted_stages(batched, opts), edges_for(opts), prefix_counts(opts))
    else:
        pairs = edge_pairs(batched, edges_for(opts))
    kept = edge_dropout(pairs, opts.loss_dropout, opts.seed)
    predicted = predict_stage(kept, "context", "pred", opts, encoder=encoder, counted=counted)
    encoded = encode(predicted, "target", "true", opts, encoder=encoder, counted=counted)
    return losses.edge_loss(encoded, opts.edge_loss_type)
