"""Inputs of the registered queries, reshaped from the given tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.config import CHAIN_EDGES, Options
from stagecraft.functions.text import FLIP_PAIRS
from stagecraft.operators.studies import DROPOUTS, LAMBDAS
from stagecraft.scratch import scratch_dir
from stagecraft.sources.shards import build_or_reuse, read_split

# Every row of every split; the cap operators set their own limits.
WHOLE = Options(max_train_examples=None, max_test_examples=None,
                perplexity_eval_examples=None, collapse_eval_examples=None)

# Limits small enough to bind on the test tables, for the operators whose point they are.
CAPPED = Options(max_papers_per_field=20, max_train_examples=400, max_test_examples=200,
                 perplexity_eval_examples=100, shuffle_buffer=100, batch_size=8)
POOL_SEED = 0
SHUFFLE_SEED = 0
DROPOUT_RATE = WHOLE.loss_dropout
RUN_VARIANTS = {
    "lambda": tuple(str(v) for v in LAMBDAS),
    "ablation": ("full", "no_pred_tokens", "no_long_range_edge", "no_trivial_filter", "no_edge_loss"),
    "dropout": tuple(str(v) for v in DROPOUTS),
}

FLIP_WORDS = tuple(w for pair in FLIP_PAIRS for w in pair)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers_from(documents: DataFrame) -> DataFrame:
    """Raw paper records: each document's words cut into six stages.

    Works on a batch or a streaming ``documents``.
    """
    words = F.array_remove(F.split("text", "[ \t\r\n]+"), "")
    split = documents.select("doc_id", "source", "n_chars", words.alias("w"))
    n = F.size("w")

    def cut(k: int) -> Column:
        start, end = F.floor(n * k / 6), F.floor(n * (k + 1) / 6)
        return F.array_join(F.slice("w", (start + 1).cast("int"), (end - start).cast("int")), " ")

    # Cutting inside a generator makes each text be split once, however often the slices
    # are referred to (and filtered on) above it.
    slices = F.inline(F.array(F.struct(
        n.alias("n"), *[cut(k).alias(f"s{k}") for k in range(6)])))
    base = split.select("doc_id", "source", "n_chars", slices)
    doc, n = F.col("doc_id"), F.col("n")
    flip_word = F.element_at(F.array(*[F.lit(w) for w in FLIP_WORDS]), (doc % 28 + 1).cast("int"))
    appended = F.concat(
        F.col("s4"), F.lit(" "), F.when(doc % 3 == 0, F.upper(flip_word)).otherwise(flip_word),
        F.when(doc % 5 == 0, F.lit(" improve degrade")).otherwise(F.lit("")))
    year_kind, second_kind = F.floor(doc / 20) % 10, F.floor(doc / 20) % 20
    # Year strings by kind; kind 0 is null, 8 and 9 use the document number.
    texts = (None, "n.d.", "2025", "2025-03-01", "2030", "c. 2019", "12345", "0000")
    listed = F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]),
                          F.least(year_kind + 1, F.lit(8)).cast("int"))
    year = F.when(year_kind <= 7, listed).otherwise((2010 + doc % 15).cast("string"))
    second_year = (F.when(second_kind == 0, F.lit(2018.7)).when(second_kind == 1, F.lit(2025.0))
                   .when(second_kind == 10, F.lit(float("nan"))))
    return base.select(
        doc.alias("seq"),
        F.when(doc != 5, F.concat(F.lit("P"), doc.cast("string"))).alias("paper_id"),
        F.col("s0").alias("summary_title"),
        F.when(doc % 41 == 0, F.lit(None).cast("string")).when(doc % 43 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("  "), F.col("s1"), F.lit(" "))).alias("research_question_hypothesis"),
        F.col("s2").alias("methodological_details"),
        F.col("s3").alias("procedures_architectures"),
        F.when((n < 6) | (doc % 4 == 0), F.col("s4")).otherwise(appended).alias("key_results"),
        F.col("s5").alias("interpretation_implications"),
        year.alias("oa_year"),
        second_year.alias("source_year"),
        F.when(doc % 13 != 0, F.col("n_chars") % 120).alias("oa_cited_by_count"),
        F.when(doc % 17 == 0, F.lit(" ")).when(doc % 19 == 0, F.lit(None).cast("string"))
        .when(doc.between(1, 3), F.lit("rare"))
        .otherwise(F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("field_subfield"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers_from(table(spark, sf_dir, "documents"))


def arrival_files(documents: DataFrame, parts: int = 4) -> int:
    """Files of one of ``parts`` arrivals: as many as tasks that read that share of the table."""
    return -(-documents.rdd.getNumPartitions() // parts)


def arrive(documents: DataFrame, part: int, inbox: str, parts: int = 4, files: int = 1) -> None:
    """Put one of ``parts`` ranges of doc_id into ``inbox``, as the ``files`` files of one
    arrival. Arrivals come in turn, and each has exactly that many files, so that a stream can
    take them one by one; pieces without rows are files all the same."""
    low, high = (documents.agg(f("doc_id")).first()[0] or 0 for f in (F.min, F.max))
    step = (high - low) // parts + 1
    slot = F.floor((F.col("doc_id") - low) / step)
    rows = documents.where(slot == part)
    rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
    rows.write.mode("append").parquet(inbox)
    written = len(documents.sparkSession.read.schema(documents.schema).parquet(inbox).inputFiles())
    for _ in range(written, (part + 1) * files):
        documents.limit(0).write.mode("append").parquet(inbox)


_bases: dict[tuple[str, str], str] = {}


def shards(spark: SparkSession, sf_dir: str) -> str:
    """Directory of the whole split chain dataset, built by the first query that reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        _bases[key] = scratch_dir(spark, "shards")
    return build_or_reuse(papers(spark, sf_dir), _bases[key], WHOLE, input_id=sf_dir) + "/chains"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(shards(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_split(spark, shards(spark, sf_dir), name)


def emb_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted/true vector pairs in batches of four, one edge per batch.

    A pair's true vector is its own in every fifth batch, else the next row's.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    total = rows.select(F.count("*")).scalar()
    vec, batch = F.col("vec_id"), F.floor(F.col("vec_id") / 4)
    wanted = rows.withColumn("batch_id", batch.cast("bigint")).withColumn(
        "_true_id", F.when(batch % 5 == 0, vec).otherwise((vec + 1) % total))
    truth = rows.select(F.col("vec_id").alias("_true_id"), F.col("embedding").alias("true"))
    edge = F.element_at(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in CHAIN_EDGES]),
        (F.col("batch_id") % 6 + 1).cast("int"))
    return wanted.join(truth, "_true_id").select(
        vec.alias("pair_id"), "batch_id", edge["i"].alias("i"), edge["j"].alias("j"),
        F.col("embedding").alias("pred"), "true", "label")


def surprise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = emb_pairs(spark, sf_dir)
    return pairs.withColumn("citations", F.col("pair_id") * 7919 % 101).withColumn(
        "field", F.col("label").cast("string"))


def runs(spark: SparkSession, sf_dir: str, study: str = "lambda") -> DataFrame:
    """Twenty run records (five variants x four seeds) aggregated from the events."""
    events = table(spark, sf_dir, "events")
    value = F.col("value")
    variant = F.element_at(F.array(*[F.lit(v) for v in RUN_VARIANTS[study]]),
                           (F.col("user_id") % 5 + 1).cast("int"))
    return events.groupBy(variant.alias("variant"), (F.col("event_id") % 4).alias("seed")).agg(
        F.avg(value).alias("perplexity"),
        F.count("*").alias("steps"),
        F.sum(value).alias("wall_time_s"),
        F.sum(F.col("event_id") % 7).alias("edges_run"),
        (F.avg(value) / 1000).alias("mean_pairwise_cos"),
        (F.max(value) / 10).alias("effective_rank"),
    ).withColumn("study", F.lit(study))

