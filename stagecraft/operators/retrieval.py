"""Score the candidates of each pool, rank them, and measure recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.text import tokens
from stagecraft.functions.vectors import Encoder, dot, encode, predict_stage
from stagecraft.scratch import materialise

# Okapi BM25 constants.
K1 = 1.5
B = 0.75
EPSILON = 0.25

_CONTEXT_POS = -1
# Tokens whose rows one task counts and sorts; the tasks grow with the texts.
TOKENS_PER_TASK = 500_000


def bm25_scores(pools: DataFrame, contexts: DataFrame) -> DataFrame:
    """Okapi BM25 of the context against the pool's candidates, each pool its own corpus.

    The context travels as one more document of its pool, so everything, including the
    query term counts, is computed behind a single exchange on ``pool_id``. A negative idf
    becomes EPSILON times the mean idf of the pool's vocabulary.

    A token becomes a row many times its size behind the exchange, so the exchange is cut by
    the number of tokens and not by its bytes: the documents are written once and counted.
    Texts cross it and are cut into tokens behind it: a task keeps all it sends, and an array
    of tokens takes more than twice the bytes of its text.
    """
    documents = pools.select("pool_id", "pos", "is_true", "text").unionByName(
        contexts.select("pool_id", F.lit(_CONTEXT_POS).alias("pos"),
                        F.lit(False).alias("is_true"), F.col("ctx").alias("text")))
    is_candidate = F.col("pos") != _CONTEXT_POS
    pool = Window.partitionBy("pool_id")
    texts = _dealt(documents.withColumn("_len", F.size(tokens(F.lower("text")))))
    measured = texts.withColumns({
        "_docs": F.sum(is_candidate.cast("int")).over(pool),
        "_avg_len": F.avg(F.when(is_candidate, F.col("_len"))).over(pool)})
    per_document = ["pool_id", "pos", "is_true", "_len", "_docs", "_avg_len"]
    tf = measured.select(*per_document, F.explode_outer(tokens(F.lower("text"))).alias("_term")).groupBy(
        *per_document, "_term").agg(F.count("_term").alias("_tf"))

    term = Window.partitionBy("pool_id", "_term")
    counted = tf.withColumns({
        "_df": F.sum((is_candidate & F.col("_term").isNotNull()).cast("int")).over(term),
        "_query_tf": F.sum(F.when(is_candidate, 0).otherwise(F.col("_tf"))).over(term),
        "_first": F.min(F.when(is_candidate, F.col("pos"))).over(term)})
    raw_idf = F.log(F.col("_docs") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)
    once = F.col("_term").isNotNull() & (F.col("pos") == F.col("_first"))
    weighed = counted.withColumn("_idf", raw_idf).withColumn(
        "_mean_idf", F.avg(F.when(once, F.col("_idf"))).over(pool))
    idf = F.when(F.col("_idf") < 0, EPSILON * F.col("_mean_idf")).otherwise(F.col("_idf"))
    length = K1 * (1 - B + B * F.try_divide(F.col("_len"), F.col("_avg_len")))
    gain = F.when(
        (F.col("_query_tf") > 0) & (F.col("_tf") > 0),
        F.col("_query_tf") * idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + length),
    ).otherwise(F.lit(0.0))
    return weighed.where(is_candidate).groupBy("pool_id", "pos", "is_true").agg(
        F.sum(gain).alias("score"))


def _dealt(texts: DataFrame) -> DataFrame:
    """Whole pools dealt to tasks of about TOKENS_PER_TASK tokens (``_len`` of each text)."""
    texts = materialise(texts, "texts")
    total = texts.agg(F.coalesce(F.sum(F.greatest("_len", F.lit(0))), F.lit(0))).first()[0]
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(max(cores, -(-total // TOKENS_PER_TASK)), "pool_id")


def dense_scores(pools: DataFrame, contexts: DataFrame, opts: Options, *,
                 encoder: Encoder | None = None) -> DataFrame:
    """Cosine of the vector predicted from the context with each candidate's vector."""
    predicted = predict_stage(contexts, "ctx", "_pred", opts, encoder=encoder)
    encoded = encode(pools, "text", "_vec", opts, encoder=encoder)
    joined = encoded.select("pool_id", "pos", "is_true", "_vec").join(
        predicted.select("pool_id", "_pred"), "pool_id")
    return joined.select("pool_id", "pos", "is_true", dot("_pred", "_vec").alias("score"))


def dense_from_store(places: DataFrame, store: DataFrame) -> DataFrame:
    """Cosine scores of pools given by the chains of their candidates (see pool_places).

    ``store`` holds, once for each chain, the vectors of its context (``pred``), its result
    (``own``) and its flipped result (``flip``), so no text is encoded twice however many
    pools it stands in. A pool's own candidates meet both vectors in one row.
    """
    candidate = store.select(F.col("seq").alias("cand_seq"), "own", "flip")
    context = store.select(F.col("seq").cast("string").alias("pool_id"), "pred")
    own = places.where("kind <> 'random'").join(
        store.withColumn("pool_id", F.col("seq").cast("string")), "pool_id").select(
        "pool_id", "pos", "is_true", "pred", F.when(F.col("kind") == "flip", F.col("flip")).otherwise(
            F.col("own")).alias("vec"))
    others = places.where("kind = 'random'").join(candidate, "cand_seq").join(context, "pool_id").select(
        "pool_id", "pos", "is_true", "pred", F.col("own").alias("vec"))
    return own.unionAll(others).select("pool_id", "pos", "is_true", dot("pred", "vec").alias("score"))


def rank_candidates(scored: DataFrame, digits: int | None = None) -> DataFrame:
    """Rank 1 is the best score; equal scores keep their pool order. Scores are rounded
    first only where the caller gives ``digits``."""
    score = F.col("score") if digits is None else F.round("score", digits)
    best = Window.partitionBy("pool_id").orderBy(F.desc(score + 0.0), "pos")
    return scored.withColumn("rank", F.row_number().over(best))


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    rank = F.col("rank")
    return ranked.where("is_true").agg(
        F.avg((rank == 1).cast("double")).alias("recall_at_1"),
        F.avg((rank <= 5).cast("double")).alias("recall_at_5"),
        F.avg(1.0 / rank).alias("mrr"))


def bm25_recall(scored: DataFrame, digits: int | None = None) -> DataFrame:
    return rank_candidates(scored, digits).where("is_true").agg(
        F.avg((F.col("rank") == 1).cast("double")).alias("recall_at_1"))
