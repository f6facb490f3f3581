"""The registered queries: every operator over whole tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.catalog import fixtures as fx
from stagecraft.config import STAGES
from stagecraft.functions import text, vectors
from stagecraft.functions.significance import t_two_sided_p
from stagecraft.operators import (
    association, caps, chains, health, labels, lm, losses, ordering, pools, retrieval, studies,
)
from stagecraft.plans import dataset, evaluation
from stagecraft.scratch import scratch_dir
from stagecraft.sources import papers as paper_source
from stagecraft.sources import shards, studies as study_source, trainer
from stagecraft.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Scores are ranked as the statements rank them: engines differ in the last bits.
DIGITS = 6
ROW = (*STAGES, "id", "year", "citations", "field", "seq")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(col, digits: int = 6) -> Column:
    """Rounded for comparison across engines; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col, digits) + 0.0


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


def tests(spark, sf_dir):
    return fx.split(spark, sf_dir, "test")


def trains(spark, sf_dir):
    return fx.split(spark, sf_dir, "train")


# ---- sources and sinks -------------------------------------------------------------------

@query
def read_papers(spark, sf_dir):
    path = scratch_dir(spark, "papers")
    fx.papers(spark, sf_dir).write.parquet(path)
    return paper_source.read_papers(spark, path, fx.WHOLE)


@query
def write_shards(spark, sf_dir):
    path = scratch_dir(spark, "written")
    shards.write_shards(dataset.split_chains(fx.papers(spark, sf_dir), fx.WHOLE), path, fx.WHOLE)
    return spark.read.parquet(path)


def _manifest(spark, directory):
    return spark.read.json(f"{directory}/manifest", schema=(
        "signature string, input string, counts map<string,bigint>")).select(
        "signature", "input", F.explode("counts").alias("split", "n"))


@query
def build_or_reuse(spark, sf_dir):
    """Builds, then asks again: the second call must find the first one's directory."""
    base = scratch_dir(spark, "builds")
    papers = fx.papers(spark, sf_dir)
    built = shards.build_or_reuse(papers, base, fx.CAPPED)
    again = shards.build_or_reuse(papers, base, fx.CAPPED)
    return _manifest(spark, built).withColumn("reused", F.lit(built == again))


@query
def build_by_input(spark, sf_dir):
    """The same rows in another order find the first build, fewer rows under the same base get
    their own. The manifests of both inputs."""
    base = scratch_dir(spark, "builds")
    papers = fx.papers(spark, sf_dir)
    built = shards.build_or_reuse(papers, base, fx.CAPPED)
    again = shards.build_or_reuse(papers.repartition("paper_id"), base, fx.CAPPED)
    fewer = shards.build_or_reuse(papers.where("seq % 3 <> 0"), base, fx.CAPPED)
    return _manifest(spark, built).withColumn("reused", F.lit(built == again)).unionAll(
        _manifest(spark, fewer).withColumn("reused", F.lit(built == fewer)))


@query
def build_whole(spark, sf_dir):
    """A build without any cap, over all papers."""
    papers = fx.papers(spark, sf_dir)
    return _manifest(spark, shards.build_or_reuse(papers, scratch_dir(spark, "builds"), fx.WHOLE))


@query
def input_fingerprint(spark, sf_dir):
    papers = fx.papers(spark, sf_dir)
    return spark.createDataFrame([(shards.input_fingerprint(papers),)], "input string")


@query
def trainer_output(spark, sf_dir):
    """Rows as each worker meets them in its files, one after the other."""
    path, o = scratch_dir(spark, "trainer"), fx.CAPPED
    opts = o.but(shard_rows=o.shuffle_buffer, seed=fx.SHUFFLE_SEED)
    trainer.write_worker_files(fx.chains(spark, sf_dir), path, opts)
    return trainer.read_positions(spark, path).select(
        "seq", "id", "split", "worker", F.col("file_pos").alias("order_pos"))


@query
def read_split(spark, sf_dir):
    return shards.read_split(spark, fx.shards(spark, sf_dir), "test")


@query
def ingest_stream(spark, sf_dir):
    out, state = scratch_dir(spark, "stream"), scratch_dir(spark, "state")
    schema = fx.table(spark, sf_dir, "documents").schema
    documents = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/documents*.parquet")
    ingest.ingest_stream(fx.papers_from(documents), out, state, fx.CAPPED).awaitTermination()
    return ingest.read_ingested(spark, out)


@query
def ingest_in_batches(spark, sf_dir):
    """Four arrivals, one for each micro-batch: two are ingested, then the query is restarted
    from its checkpoint for two more. ``batch_id`` is the micro-batch that wrote the row."""
    out, state, inbox = (scratch_dir(spark, n) for n in ("stream", "state", "inbox"))
    documents = fx.table(spark, sf_dir, "documents")
    files = fx.arrival_files(documents)
    for parts in ((0, 1), (2, 3)):
        for part in parts:
            fx.arrive(documents, part, inbox, files=files)
        arrived = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files).parquet(inbox)
        ingest.ingest_stream(fx.papers_from(arrived), out, state, fx.CAPPED).awaitTermination()
    return ingest.read_ingested(spark, out, with_batch=True)


@query
def write_study(spark, sf_dir):
    summary = studies.summarise_ablation(fx.runs(spark, sf_dir, "ablation"))
    path = study_source.write_study(summary, scratch_dir(spark, "studies"), "ablation")
    return rounded(spark.read.schema(summary.schema).json(path), "perplexity_mean",
                   "perplexity_std", "mean_pairwise_cos")


@query
def plot_series(spark, sf_dir):
    summary = studies.summarise_dropout(fx.runs(spark, sf_dir, "dropout"))
    return rounded(study_source.plot_series(summary, "variant", "perplexity_mean"), "y")


# ---- projections and filters -------------------------------------------------------------

@query
def build_chains(spark, sf_dir):
    return chains.build_chains(fx.papers(spark, sf_dir), fx.WHOLE)


@query
def parse_year(spark, sf_dir):
    return chains.parse_year(fx.papers(spark, sf_dir), fx.WHOLE).select("seq", "year")


@query
def normalise_field(spark, sf_dir):
    return chains.normalise_field(fx.papers(spark, sf_dir), fx.WHOLE).select("seq", "field")


@query
def assign_split(spark, sf_dir):
    return dataset.split_chains(fx.papers(spark, sf_dir), fx.WHOLE).select(
        "seq", "id", "year", "split")


@query
def full_text(spark, sf_dir):
    return chains.with_full_text(fx.chains(spark, sf_dir)).select("seq", "full_text")


@query
def prefix_context(spark, sf_dir):
    return chains.with_context(fx.chains(spark, sf_dir)).select("seq", "ctx")


@query
def edge_pairs(spark, sf_dir):
    return chains.edge_pairs(fx.chains(spark, sf_dir)).select(
        "id", "seq", "i", "j", "context", "target")


@query
def filter_edges(spark, sf_dir):
    pairs = chains.edge_pairs(fx.chains(spark, sf_dir))
    return chains.filter_edges(pairs, fx.WHOLE.but(use_long_range_edge=False)).select(
        "seq", "i", "j", "target")


@query
def edge_dropout(spark, sf_dir):
    return chains.edge_dropout(fx.emb_pairs(spark, sf_dir), fx.DROPOUT_RATE,
                               fx.SHUFFLE_SEED).select("pair_id", "batch_id", "i", "j")


@query
def flip_findings(spark, sf_dir):
    return fx.chains(spark, sf_dir).select("seq", text.flip_findings("result").alias("flipped"))


@query
def truncate_tokens(spark, sf_dir):
    o = fx.WHOLE
    return fx.chains(spark, sf_dir).select(
        "seq", text.truncate_tokens("result", o.max_stage_tokens).alias("stage"),
        text.truncate_tokens(text.prefix_context(), o.context_tokens).alias("ctx"),
        text.truncate_tokens(text.full_text(), o.full_text_tokens).alias("full_text"))


@query
def log_citations(spark, sf_dir):
    return fx.chains(spark, sf_dir).select(
        "seq", r6(labels.log_citations("citations")).alias("log_citations"))


@query
def prediction_prompt(spark, sf_dir):
    return fx.chains(spark, sf_dir).select(
        "seq", text.prediction_prompt(text.prefix_context(), fx.WHOLE).alias("prompt"))


# ---- caps, order, batches ----------------------------------------------------------------

@query
def cap_per_field(spark, sf_dir):
    return caps.cap_per_field(fx.chains(spark, sf_dir), fx.CAPPED).select("seq", "field", "split")


@query
def cap_per_split(spark, sf_dir):
    capped = caps.cap_per_field(fx.chains(spark, sf_dir), fx.CAPPED)
    return caps.cap_per_split(capped, fx.CAPPED).select("seq", "field", "split")


@query
def head_n(spark, sf_dir):
    return caps.head_n(tests(spark, sf_dir), fx.CAPPED.perplexity_eval_examples).select("seq", "id")


def _shuffled(df):
    return ordering.block_shuffle(df, fx.CAPPED.shuffle_buffer, fx.SHUFFLE_SEED)


@query
def block_shuffle(spark, sf_dir):
    return _shuffled(fx.chains(spark, sf_dir)).select("seq", "split", "order_pos")


@query
def stripe(spark, sf_dir):
    return ordering.stripe(fx.chains(spark, sf_dir), fx.CAPPED.num_workers,
                           fx.CAPPED.shuffle_buffer).select("seq", "split", "worker")


@query
def worker_order(spark, sf_dir):
    o = fx.CAPPED
    return ordering.worker_order(
        fx.chains(spark, sf_dir), o.num_workers, o.shuffle_buffer, fx.SHUFFLE_SEED,
        o.shuffle_buffer).select("seq", "split", "worker", "order_pos")


@query
def assign_batches(spark, sf_dir):
    return ordering.assign_batches(_shuffled(fx.chains(spark, sf_dir)),
                                   fx.CAPPED.batch_size).select("seq", "split", "batch_id")


# ---- pools and retrieval -----------------------------------------------------------------

def _pools(test):
    return pools.build_pools(test, fx.WHOLE.n_distractors, fx.POOL_SEED)


def _bm25(spark, sf_dir):
    test = tests(spark, sf_dir)
    return retrieval.bm25_scores(_pools(test), pools.contexts(test))


def _dense(spark, sf_dir):
    test = tests(spark, sf_dir)
    places = pools.pool_places(test, fx.WHOLE.n_distractors, fx.POOL_SEED)
    return retrieval.dense_from_store(places, evaluation.vector_store(test, fx.WHOLE))


@query
def build_pools(spark, sf_dir):
    return _pools(tests(spark, sf_dir))


@query
def shared_pools(spark, sf_dir):
    return pools.shared_pools(tests(spark, sf_dir), fx.WHOLE.n_distractors, fx.POOL_SEED)


@query
def bm25_scores(spark, sf_dir):
    return rounded(_bm25(spark, sf_dir), "score")


@query
def rank_candidates(spark, sf_dir):
    return retrieval.rank_candidates(_bm25(spark, sf_dir), DIGITS).select("pool_id", "pos", "is_true", "rank")


@query
def bm25_recall(spark, sf_dir):
    return rounded(retrieval.bm25_recall(_bm25(spark, sf_dir), DIGITS), "recall_at_1")


@query
def dense_scores(spark, sf_dir):
    return rounded(_dense(spark, sf_dir), "score")


@query
def retrieval_metrics(spark, sf_dir):
    ranked = retrieval.rank_candidates(_dense(spark, sf_dir), DIGITS)
    return rounded(retrieval.retrieval_metrics(ranked), "recall_at_1", "recall_at_5", "mrr")


# ---- encoders ----------------------------------------------------------------------------

def _rounded_vector(name: str) -> Column:
    return F.transform(name, lambda x: F.round(x, 6)).alias("vec")


@query
def encode(spark, sf_dir):
    rows = fx.chains(spark, sf_dir).select("seq", "result")
    return vectors.encode(rows, "result", "v", fx.WHOLE).select("seq", _rounded_vector("v"))


@query
def predict_stage(spark, sf_dir):
    rows = chains.with_context(fx.chains(spark, sf_dir)).select("seq", "ctx")
    return vectors.predict_stage(rows, "ctx", "v", fx.WHOLE).select("seq", _rounded_vector("v"))


@query
def l2_normalise(spark, sf_dir):
    unit = F.transform(vectors.l2_normalise("pred"), lambda x: F.round(x, 5))
    return fx.emb_pairs(spark, sf_dir).select(
        "pair_id", r6(vectors.dot("pred", "true")).alias("dot"),
        F.round(F.sqrt(vectors.dot("pred", "pred")), 5).alias("norm"), unit.alias("unit"))


# ---- labels and counts -------------------------------------------------------------------

@query
def citation_labels(spark, sf_dir):
    rows = fx.chains(spark, sf_dir).select("seq", "field", "citations")
    return labels.citation_labels(rows, fx.WHOLE).select("seq", "field", "label")


@query
def median_labels(spark, sf_dir):
    rows = fx.chains(spark, sf_dir).select("seq", "field", "citations")
    return labels.citation_labels(rows, fx.WHOLE.but(label_strategy="median")).select("seq", "label")


@query
def positive_rate(spark, sf_dir):
    rows = tests(spark, sf_dir).select("seq", "field", "citations")
    by_field = labels.positive_rate(labels.citation_labels(rows, fx.WHOLE), "field")
    return rounded(by_field, "positive_rate")


@query
def split_counts(spark, sf_dir):
    return labels.split_counts(fx.chains(spark, sf_dir))


@query
def field_counts(spark, sf_dir):
    return labels.field_counts(fx.chains(spark, sf_dir))


# ---- language model ----------------------------------------------------------------------

def _nll(spark, sf_dir):
    model = lm.fit_bigram(trains(spark, sf_dir))
    return lm.score_bigram(model, tests(spark, sf_dir), fx.WHOLE)


@query
def bigram_model(spark, sf_dir):
    return lm.fit_bigram(trains(spark, sf_dir)).counts.select("v", "w", "n")


@query
def token_nll(spark, sf_dir):
    return rounded(_nll(spark, sf_dir), "nll")


@query
def perplexity(spark, sf_dir):
    scored = lm.corpus_perplexity(lm.fit_bigram(trains(spark, sf_dir)), tests(spark, sf_dir), fx.WHOLE)
    return scored.select(
        r6("perplexity", 4).alias("perplexity"), r6("avg_nll").alias("avg_nll"))


# ---- losses and embedding health -----------------------------------------------------------

@query
def edge_loss(spark, sf_dir):
    return rounded(losses.edge_loss(fx.emb_pairs(spark, sf_dir)), "cos", "loss")


@query
def edge_loss_mse(spark, sf_dir):
    return rounded(losses.edge_loss(fx.emb_pairs(spark, sf_dir), "mse"), "cos", "loss")


@query
def drop_trivial_edges(spark, sf_dir):
    return losses.drop_trivial_edges(losses.edge_loss(fx.emb_pairs(spark, sf_dir))).select(
        "batch_id", "i", "j")


def _kept_pairs(spark, sf_dir):
    return chains.edge_dropout(fx.emb_pairs(spark, sf_dir), fx.DROPOUT_RATE, fx.SHUFFLE_SEED)


@query
def combined_loss(spark, sf_dir):
    nll = fx.emb_pairs(spark, sf_dir).groupBy("batch_id").agg(
        (F.sum("pair_id") / 1000.0).alias("nll"))
    used = losses.drop_trivial_edges(losses.edge_loss(_kept_pairs(spark, sf_dir)))
    return rounded(losses.combined_loss(nll, used, 0.5), "loss")


@query
def edges_run(spark, sf_dir):
    return losses.edges_run(_kept_pairs(spark, sf_dir))


@query
def mean_pairwise_cos(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return rounded(health.mean_pairwise_cos(rows, "embedding"), "mean_pairwise_cos")


@query
def effective_rank(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return rounded(health.effective_rank(rows, "embedding"), "effective_rank")


@query
def gram_cells(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return rounded(health.gram_cells(rows, "embedding"), "value", digits=4)


@query
def surprise(spark, sf_dir):
    scored = losses.surprise(fx.emb_pairs(spark, sf_dir))
    return scored.select("pair_id", r6("surprise").alias("surprise"))


def _surprise(spark, sf_dir):
    return losses.surprise(fx.surprise_rows(spark, sf_dir)).select(
        "pair_id", "field", "citations", "surprise")


@query
def spearman(spark, sf_dir):
    result = association.spearman(_surprise(spark, sf_dir), "surprise", "citations", "pair_id", DIGITS)
    return rounded(result, "spearman_rho", "spearman_p")


@query
def auroc(spark, sf_dir):
    labelled = labels.citation_labels(
        _surprise(spark, sf_dir).withColumnRenamed("pair_id", "seq"), fx.WHOLE)
    return rounded(association.auroc(labelled, "label", "surprise", DIGITS), "auroc")


# ---- studies -------------------------------------------------------------------------------

@query
def study_grid(spark, sf_dir):
    seeds = fx.runs(spark, sf_dir).select("seed").distinct()
    grid = studies.study_grid(seeds, ("lambda", "ablation", "dropout"))
    pairs = F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return grid.select("study", "variant", "seed", F.array_join(F.array_sort(pairs), ";").alias("settings"))


@query
def pair_with_baseline(spark, sf_dir):
    return rounded(studies.pair_with_baseline(fx.runs(spark, sf_dir), "0.0"), "value", "base_value")


@query
def throughput(spark, sf_dir):
    return studies.throughput(fx.runs(spark, sf_dir)).select(
        "variant", "seed", r6("steps_per_sec").alias("steps_per_sec"))


@query
def run_record(spark, sf_dir):
    runs = fx.runs(spark, sf_dir)
    key = ["study", "variant", "seed"]
    stats = runs.select(*key, "steps", "edges_run", "wall_time_s")
    metrics = runs.select(
        *key, "perplexity", (F.col("perplexity") / 100).alias("F1_recall1"),
        (F.col("perplexity") / 200).alias("F1_bm25_recall1"),
        F.col("mean_pairwise_cos").alias("F2_rho"), "mean_pairwise_cos", "effective_rank")
    record = rounded(studies.run_record(stats, metrics), "perplexity", "F1_recall1",
                     "F1_bm25_recall1", "F2_rho", "mean_pairwise_cos", "effective_rank")
    return rounded(record, "wall_time_s", digits=4)


@query
def summarise_lambda(spark, sf_dir):
    summary = studies.summarise_lambda(fx.runs(spark, sf_dir))
    return rounded(summary, "perplexity_mean", "perplexity_std", "mean_pairwise_cos",
                   "effective_rank").withColumn(
        "perplexities", F.transform("perplexities", lambda x: F.round(x, 6)))


@query
def summarise_ablation(spark, sf_dir):
    return rounded(studies.summarise_ablation(fx.runs(spark, sf_dir, "ablation")),
                   "perplexity_mean", "perplexity_std", "mean_pairwise_cos")


@query
def summarise_dropout(spark, sf_dir):
    return rounded(studies.summarise_dropout(fx.runs(spark, sf_dir, "dropout")),
                   "perplexity_mean", "steps_per_sec_mean", "edges_run_mean")


def _ttests(spark, sf_dir):
    return studies.paired_ttest(studies.pair_with_baseline(fx.runs(spark, sf_dir), "0.0"))


@query
def paired_ttest(spark, sf_dir):
    return rounded(_ttests(spark, sf_dir), "t_stat", "p_value").select(
        "study", "variant", "t_stat", "p_value")


@query
def t_p_values(spark, sf_dir):
    t, df = F.col("perplexity") / 20, (F.col("steps") % 40 + 1)
    return fx.runs(spark, sf_dir).select(
        "variant", "seed", r6(t).alias("t"), df.alias("df"), r6(t_two_sided_p(t, df)).alias("p"))


@query
def holm(spark, sf_dir):
    return studies.holm(_ttests(spark, sf_dir)).select("study", "variant", "significant_holm")


@query
def significance_report(spark, sf_dir):
    return rounded(studies.significance_report(fx.runs(spark, sf_dir), "0.0"), "p_value")


# ---- whole flows ---------------------------------------------------------------------------

@query
def evaluate_all(spark, sf_dir):
    report = evaluation.evaluate_all(trains(spark, sf_dir), tests(spark, sf_dir), fx.WHOLE,
                                     with_rank=False, digits=DIGITS)
    return rounded(report, "value", digits=4)


@query
def evaluate_all_with_rank(spark, sf_dir):
    report = evaluation.evaluate_all(trains(spark, sf_dir), tests(spark, sf_dir), fx.WHOLE, digits=DIGITS)
    return rounded(report, "value", digits=4)


@query
def training_losses(spark, sf_dir):
    opts = fx.WHOLE.but(shuffle_buffer=fx.CAPPED.shuffle_buffer, batch_size=fx.CAPPED.batch_size,
                        loss_dropout=fx.DROPOUT_RATE, seed=fx.SHUFFLE_SEED)
    return rounded(evaluation.training_losses(trains(spark, sf_dir), opts), "nll", "loss", digits=5)
