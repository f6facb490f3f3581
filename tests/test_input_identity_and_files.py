"""Builds named by their input, trainer files, sparse vectors, cuts and quantiles by range."""

import hashlib
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import make_chains
from stagecraft.config import Options
from stagecraft.functions import vectors
from stagecraft.operators import caps, health, labels, ordering, pools, retrieval, studies
from stagecraft.plans import evaluation
from stagecraft.scratch import materialise
from stagecraft.sources import shards, trainer

COLUMNS = {c: "abc" for _, c in Options().stage_columns}


def papers(spark, seqs, **changed):
    rows = [{**COLUMNS, "paper_id": f"P{s}", "oa_year": "2020", "oa_cited_by_count": s, "field_subfield": "f",
             "seq": s, **changed} for s in seqs]
    return spark.createDataFrame(rows)


def test_two_inputs_under_one_base_are_two_builds(spark, tmp_path):
    low, high = papers(spark, range(0, 30)), papers(spark, range(30, 70))
    first = shards.build_or_reuse(low, str(tmp_path), Options())
    second = shards.build_or_reuse(high, str(tmp_path), Options())
    assert first != second
    for directory, count in ((first, 30), (second, 40)):
        assert spark.read.parquet(directory + "/chains").count() == count
        manifest = shards.read_manifest(spark, directory)
        assert manifest["input"].split("-")[0] == str(count) and manifest["counts"] == {"train": count}
    again = low.repartition(3, "paper_id").select(*reversed(low.columns))
    assert shards.build_or_reuse(again, str(tmp_path), Options()) == first
    assert shards.build_or_reuse(low, str(tmp_path), Options(), input_id="v1") not in (first, second)


def test_fingerprints_see_values_nulls_and_borders(spark):
    def mark(rows):
        return shards.input_fingerprint(spark.createDataFrame(rows, "a string, b string"))

    marks = [mark(rows) for rows in (
        [("x", "yz")], [("xy", "z")], [("x", None)], [("x", "")], [(None, "x")], [("x", "yz"), ("x", "yz")], [])]
    assert len(set(marks)) == len(marks) and marks[-1] == "0-0"
    assert mark([("a", "b"), ("c", "d")]) == mark([("c", "d"), ("a", "b")])


def test_a_worker_reads_its_files_in_order(spark, tmp_path):
    df = make_chains(spark, [(s, f"P{s}", "train" if s % 3 else "test", "f", 1, "r") for s in range(1000)])
    opts = Options(num_workers=3, shuffle_buffer=40, shard_rows=50)
    trainer.write_worker_files(df, str(tmp_path), opts, seed=5)
    want = ordering.worker_order(df, 3, 40, 5, 50)
    assert {(r.seq, r.worker, r.file_pos) for r in trainer.read_positions(spark, str(tmp_path)).collect()} == {
        (r.seq, r.worker, r.order_pos) for r in want.collect()}
    # The way a trainer reads: one folder, its files by name, rows as they come.
    folder = tmp_path / "rows" / "split=train" / "worker=1"
    seqs = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".parquet")):
        part = spark.read.parquet(str(folder / name)).select("seq", F.col("_metadata.row_index").alias("i")).collect()
        assert len(part) <= 50
        seqs += [r.seq for r in sorted(part, key=lambda r: r.i)]
    own = want.where("split = 'train' and worker = 1").orderBy("order_pos").collect()
    assert seqs == [r.seq for r in own]
    assert trainer.read_worker(spark, str(tmp_path), "train", 1).count() == len(own)
    index = spark.read.parquet(str(tmp_path / "files")).where("split = 'train' and worker = 1").orderBy("number").collect()
    assert [r.first_pos for r in index] == np.cumsum([0, *(r.n for r in index)])[:-1].tolist()


def hashed(text, dim):
    out = np.zeros(dim)
    for token in text.lower().split():
        digest = hashlib.md5(token.encode()).hexdigest()
        out[int(digest[:8], 16) % dim] += 1 if digest[8] < "8" else -1
    norm = math.sqrt((out ** 2).sum())
    return out / norm if norm else out


@pytest.mark.parametrize("dim", [1, 3, 64, 1024])
def test_vectors_in_any_dimension(spark, dim):
    texts = ["", "  ", "one", "One ONE two", " ".join(f"w{k % 37}" for k in range(300)), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in vectors.encode(df, "t", "v", Options(encoder_dim=dim)).collect():
        if row.t is None:
            assert row.v is None
        else:
            assert np.allclose(row.v, hashed(row.t, dim))


def test_every_text_is_encoded_once(spark):
    df = make_chains(spark, [(s, f"P{s}", "test", "f", 1, f"result {s} improves and may increase") for s in range(40)])
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def counting(texts):
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t)), float(t.count("e")), float(t.count("1"))])

    store = evaluation.vector_store(df, Options(), counting)
    places = pools.pool_places(df, 4, 0)
    got = {(r.pool_id, r.pos): r.score for r in retrieval.dense_from_store(places, store).collect()}
    assert seen.value == 3 * 40
    written = materialise(pools.with_texts(places, df), "pools")
    texts = retrieval.dense_scores(written, pools.contexts(df), Options(), encoder=counting)
    assert got.keys() == {(r.pool_id, r.pos) for r in texts.collect()} and len(got) == 5 * 40
    # dense_scores marks the prompt for a learned encoder, as the store does.
    assert all(abs(got[r.pool_id, r.pos] - r.score) < 1e-9 for r in texts.collect())


@pytest.mark.parametrize("cap", [1, 700, 5000, 9000])
def test_field_cuts_order_one_range_of_a_hot_field(spark, conf, cap):
    conf("spark.sql.shuffle.partitions", "16")
    rows = spark.range(8000).select(
        (F.col("id") * 7919 % 8009).alias("seq"), F.lit("train").alias("split"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("f"), (F.col("id") % 70).cast("string")))
        .otherwise("hot").alias("field"))
    want = {r.field: r.cut for r in rows.withColumn("_r", F.row_number().over(
        Window.partitionBy("field").orderBy("seq"))).where(F.col("_r") == cap).select(
        "field", F.col("seq").alias("cut")).collect()}
    got = {r.field: r.cut for r in caps.field_cuts(rows, cap).collect()}
    assert {f: c for f, c in got.items() if c is not None} == want


def test_exact_quantile(spark):
    draw = np.random.default_rng(0)
    for values in ([], [3.0], [1.0, 2.0], draw.integers(0, 9, 501).astype(float), draw.random(1000)):
        counted = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
        for q in (0.0, 0.25, 0.5, 1.0):
            got = labels.exact_quantile(counted, "v", "n", q)
            assert got is None if len(values) == 0 else abs(got - np.quantile(values, q)) < 1e-12


def test_gram_cells(spark):
    rows = np.random.default_rng(1).random((20, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "vec array<double>")
    got = np.zeros((5, 5))
    for r in health.gram_cells(df).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, rows.T @ rows)


def test_variants_differ_from_the_defaults_where_they_say(spark):
    base = Options(edge_loss_weight=0.5)
    assert studies.study_variants("ablation", base)["full"] == base
    assert studies.overrides(studies.study_variants("lambda", base)["0.0"], base) == {
        "edge_loss_weight": 0.0, "edge_loss_enabled": False}
    assert all(len(studies.overrides(v)) == 1 for n, v in studies.study_variants("ablation").items() if n != "full")
    with pytest.raises(ValueError):
        studies.study_variants("other")


def test_the_entry_goes_on_without_what_only_llm_needs(tmp_path):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1') for q in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": str(tmp_path)})
    if os.path.isdir(os.path.join(root, "stagecraft", "llm")):
        assert re.fullmatch(r"\d+ False", run.stdout.strip().splitlines()[-1]), run.stderr[-500:]
