import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import make_chains
from stagecraft.catalog import fixtures
from stagecraft.config import Options
from stagecraft.plans.dataset import dataset_rows
from stagecraft.scratch import scratch_dir
from stagecraft.sources import shards, studies
from stagecraft.sources.papers import read_papers, read_papers_stream
from stagecraft.streaming import ingest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [2001, 5000])
def test_no_row_is_lost_in_shards(spark, tmp_path, rows):
    df = make_chains(spark, [(s, f"P{s}", "train", "f", 1, "r") for s in range(rows)]).coalesce(1)
    path = str(tmp_path / "out")
    shards.write_shards(df, path, Options())
    back = shards.read_split(spark, path, "train")
    assert back.select("seq").distinct().count() == rows
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) == 2000 and len(sizes) == -(-rows // 2000)


def test_build_is_reused_until_a_setting_changes(spark, tmp_path):
    papers = fixtures.papers(spark, SMALL)
    base = str(tmp_path)
    first = shards.build_or_reuse(papers, base, Options())
    stamp = {f: os.path.getmtime(os.path.join(first, "chains", f))
             for f in os.listdir(os.path.join(first, "chains"))}
    assert shards.build_or_reuse(papers, base, Options(seed=9, shuffle_buffer=7)) == first
    assert stamp == {f: os.path.getmtime(os.path.join(first, "chains", f))
                     for f in os.listdir(os.path.join(first, "chains"))}
    other = shards.build_or_reuse(papers, base, Options(max_train_examples=50))
    assert other != first
    manifest = shards.read_manifest(spark, other)
    assert manifest["counts"]["train"] == 50 == shards.read_split(
        spark, other + "/chains", "train").count()


def test_an_unreadable_manifest_means_rebuild(spark, tmp_path):
    papers = fixtures.papers(spark, SMALL)
    built = shards.build_or_reuse(papers, str(tmp_path), Options())
    want = shards.read_manifest(spark, built)
    folder = os.path.join(built, "manifest")
    for name in os.listdir(folder):
        if name.endswith(".json"):
            with open(os.path.join(folder, name), "w") as f:
                f.write("{broken")
            crc = os.path.join(folder, f".{name}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    assert shards.read_manifest(spark, built) is None
    shards.build_or_reuse(papers, str(tmp_path), Options())
    assert shards.read_manifest(spark, built) == want


def test_no_complete_paper_gives_an_empty_dataset(spark, tmp_path):
    papers = fixtures.papers(spark, SMALL).withColumn("key_results", F.lit(" "))
    built = shards.build_or_reuse(papers, str(tmp_path), Options())
    assert shards.read_manifest(spark, built)["counts"] == {}


def test_signature_covers_content_settings_only():
    base = Options().signature()
    assert len(base) == 10 and base == Options(seed=5, batch_size=9).signature()
    assert base != Options(max_stage_chars=10).signature() != Options(test_year=1).signature()
    assert base != Options(seq_column="n").signature() != Options(fallback_year_column="y").signature()


@pytest.mark.parametrize("opts", [
    Options(max_papers_per_field=6, max_train_examples=70, max_test_examples=20),
    Options(max_train_examples=None, max_test_examples=None)])
def test_stream_equals_batch(spark, tmp_path, opts):
    papers = fixtures.papers(spark, SMALL).persist()
    source = tmp_path / "in"
    source.mkdir()
    edges = [0, 35, 80, 150, 10**9]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = str(tmp_path / f"part{k}")
        papers.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.link(os.path.join(part, name), source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (time.time() - 100 + k, time.time() - 100 + k))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = read_papers_stream(spark, str(source), papers.schema, opts, files_per_batch=1)
        ingest.ingest_stream(stream, out, state, opts).awaitTermination()

    run()
    want = sorted(map(str, dataset_rows(papers, opts).collect()))
    columns = dataset_rows(papers, opts).columns
    assert sorted(map(str, ingest.read_ingested(spark, out).select(*columns).collect())) == want
    assert len(os.listdir(out + "/counts")) == 4
    run()  # nothing new arrived
    assert ingest.read_ingested(spark, out).count() == len(want)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    opts = Options(max_papers_per_field=4, max_train_examples=30, max_test_examples=5)
    from stagecraft.plans.dataset import split_chains
    rows = split_chains(fixtures.papers(spark, SMALL), opts)
    out = str(tmp_path / "out")
    halves = [rows.where("seq < 90"), rows.where("seq >= 90")]
    for batch_id in (0, 1, 1, 0):
        ingest._write_batch(halves[batch_id], batch_id, out, opts)
    got = {r["seq"] for r in ingest.read_ingested(spark, out).collect()}
    assert got == {r["seq"] for r in dataset_rows(fixtures.papers(spark, SMALL), opts).collect()}


def test_study_files_and_plot_series(spark, tmp_path):
    df = spark.createDataFrame([("0.5", 2.0), ("0.125", 1.0), ("10.0", 3.0)], "variant string, y double")
    path = studies.write_study(df, str(tmp_path), "dropout")
    back = spark.read.schema(df.schema).json(path)
    points = studies.plot_series(back, "variant", "y").collect()
    assert [(p["x"], p["y"]) for p in points] == [(0.125, 1.0), (0.5, 2.0), (10.0, 3.0)]


def test_scan_reads_configured_columns_only(spark, tmp_path):
    path = str(tmp_path / "papers")
    fixtures.papers(spark, SMALL).withColumn("unused", F.lit("x" * 50)).write.parquet(path)
    plan = read_papers(spark, path, Options())._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "key_results" in plan


def test_scratch_follows_the_named_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_an_arrival_is_dealt_to_many_files_and_still_one_batch(spark, tmp_path, conf):
    """Each arrival is written by several tasks, even where pieces have no rows, and is taken whole."""
    conf("spark.sql.files.maxPartitionBytes", "64k")
    source, inbox = str(tmp_path / "documents"), str(tmp_path / "inbox")
    rows = spark.range(60).selectExpr("id * id AS doc_id", "'s' AS source", "1L AS n_chars", "repeat(md5(string(id)), 2000) AS text")
    rows.repartition(12).write.parquet(source)
    documents = spark.read.parquet(source)
    files = fixtures.arrival_files(documents)
    assert files > 1
    for part in range(4):
        fixtures.arrive(documents.where("doc_id < 2000 OR doc_id > 3000"), part, inbox, files=files)
        assert len(spark.read.parquet(inbox).inputFiles()) == (part + 1) * files
    found = []

    def note(batch, batch_id):
        found.extend((batch_id, r["doc_id"]) for r in batch.select("doc_id").collect())

    (spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", files).parquet(inbox).writeStream
     .foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
     .start().awaitTermination())
    want = [k * k for k in range(60) if not 2000 <= k * k <= 3000]
    step = want[-1] // 4 + 1
    assert sorted(found) == sorted((d // step, d) for d in want)
