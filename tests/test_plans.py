import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from stagecraft.catalog import fixtures
from stagecraft.operators import caps, chains, ordering, pools, retrieval
from stagecraft.sources import shards

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def test_split(spark):
    return fixtures.split(spark, SMALL, "test")


def test_pools_need_no_cross_join(test_split):
    text = plan(pools.build_pools(test_split, 4, 0))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    circle = plan(pools.hash_circle(test_split, 0))
    assert "CartesianProduct" not in circle and "NestedLoop" not in circle
    assert "title" not in circle


def test_split_is_pruned_by_partition(spark):
    text = plan(shards.read_split(spark, fixtures.shards(spark, SMALL), "test"))
    assert "PartitionFilters: [isnotnull(split" in text


def test_only_needed_columns_are_read(test_split):
    text = plan(test_split.select("seq", "field"))
    assert "ReadSchema: struct<field:string,seq:bigint>" in text


def test_order_numbers_shuffle_no_texts(spark):
    df = fixtures.chains(spark, SMALL)
    placed = ordering._positions(df)
    assert "hypothesis" not in plan(placed)


def test_caps_only_filter_wide_rows(spark):
    df = fixtures.chains(spark, SMALL)
    capped = caps.cap_per_split(caps.cap_per_field(df, fixtures.CAPPED), fixtures.CAPPED)
    text = plan(capped.select("title", "seq"))
    assert "SortMergeJoin" not in text and "Window" not in text
    assert "LessThanOrEqual(seq" in plan(caps.head_n(df, 10))


def test_bm25_shuffles_once_per_input(test_split):
    frame = test_split.select(F.col("seq").cast("string").alias("pool_id"), F.lit(0).alias("pos"),
                              F.lit("true").alias("kind"), F.col("result").alias("text"),
                              F.lit(True).alias("is_true"))
    scored = retrieval.bm25_scores(frame, pools.contexts(test_split))
    physical = scored._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_edges_are_exploded_not_joined(spark):
    assert "Join" not in plan(chains.edge_pairs(fixtures.chains(spark, SMALL)))


def test_contract(spark):
    from stagecraft.catalog.queries import QUERIES

    assert set(contract.oracle_sql()) < set(contract.queries())
    assert set(QUERIES) - set(contract.oracle_sql()) == {
        "effective_rank", "evaluate_all_with_rank"}
    rows = contract.entry(spark).collect()
    assert rows and all(0 <= r["positive_rate"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["build_chains", "cap_per_split", "build_pools", "token_nll",
                                  "citation_labels", "spearman", "significance_report"])
def test_queries_agree_with_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("documents", "embeddings", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in want.description]
    expected = sorted(map(repr, want.fetchall()))
    got = contract.queries()[name](spark, SMALL).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected


def test_no_text_is_cut_by_default(spark):
    from pyspark.sql import functions as F
    from stagecraft.catalog import fixtures
    from stagecraft.config import Options
    from stagecraft.operators import chains, lm
    sf_dir = "/root/testdata/sf0.001"
    papers = fixtures.papers(spark, sf_dir)
    built = chains.build_chains(papers, Options())
    long = papers.select(F.col("seq"), F.length(F.trim("methodological_details")).alias("n")).where("n > 1000")
    kept = built.select("seq", F.length("method").alias("m")).join(long, "seq").where("m < n")
    assert long.count() and not kept.count()
    tokens = built.selectExpr("sum(size(split(concat_ws(' ', title, hypothesis, method, experiment, "
                              "result, conclusion), '[ \\\\t\\\\r\\\\n]+')) - 1)").first()[0]
    assert lm.bigrams(built).count() == tokens


def test_close_scores_are_not_tied(spark):
    from stagecraft.operators import association
    rows = spark.createDataFrame([(1e-8, 1), (2e-8, 0), (3e-8, 0), (4e-8, 0)], "s double, label int")
    assert association.auroc(rows, "label", "s").first()[0] == 0.0
