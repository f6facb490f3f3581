"""A corpus from documents to a training mix: five stages, each read from the last one's
Parquet.

1. language ID: documents without a language (no text, no letter in it) go.
2. n-gram Jaccard join on five words, similarity 0.8 or more: of each group the document
   with the smallest doc_id stays, one row of it.
3. benchmark decontamination: documents in which a test item is found go.
4. PII: personal data in the text is masked; every document stays.
5. mixing sources to target weights: what the mix takes of each document.

All but the last return the columns of documents. No oracle: SQL cannot express trained
models, R-trees or hashed permutations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.llm import bm25_decon, ecoc_lang, mixture, ngram_join, pii_crf
from stagecraft.scratch import scratch_dir

SHINGLE, PERCENT = 5, 80
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ecoc_lang.keep_identified(docs, ecoc_lang.fit(ecoc_lang.learnable(docs)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bm25_decon.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.mask(docs, pii_crf.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
