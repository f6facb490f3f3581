"""The registered queries of the dealt operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stagecraft.llm import (
    bm25_decon, ecoc_lang, fm_dedup, line_blocks, merkle, mixture, ngram_join, pii_crf,
    pitman_yor, syncmers, turn_repair, url_vocab, warc_revisit,
)
from stagecraft.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_line_block_text(spark, sf_dir):
    return line_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op6_warc_revisits(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    warc_revisit.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_revisit.read_archives(spark, path)


@query
def op10_url_vocabulary(spark, sf_dir):
    return url_vocab.judge_urls(table(spark, sf_dir, "pages"))


@query
def op4_ecoc_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ecoc_lang.identify(docs, ecoc_lang.fit(ecoc_lang.learnable(docs)))


@query
def op3_crf_personal_data(spark, sf_dir):
    return pii_crf.find(table(spark, sf_dir, "documents"), pii_crf.train())


@query
def op8_source_mixture(spark, sf_dir):
    return mixture.mix(table(spark, sf_dir, "documents"))


@query
def op7_bm25_decontamination(spark, sf_dir):
    return bm25_decon.contaminated(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))


@query
def op9_ngram_jaccard(spark, sf_dir):
    return ngram_join.grouped(table(spark, sf_dir, "documents")).drop("tag", "node", "label")


@query
def op2_fm_index_dedup(spark, sf_dir):
    return fm_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_turn_repair(spark, sf_dir):
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op12_pitman_yor(spark, sf_dir):
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
