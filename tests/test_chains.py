import pytest
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.operators import chains

OPTS = Options(max_stage_chars=1000)
STAGE_COLUMNS = [c for _, c in OPTS.stage_columns]


def papers(spark, rows, schema="seq bigint, paper_id string"):
    df = spark.createDataFrame(rows, schema)
    for c in STAGE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("some text"))
    return df


def test_stages_are_trimmed_cut_and_required(spark):
    rows = [(1, "a", "  x\t"), (2, "b", "　y "), (3, "c", "​z"),
            (4, "d", " " + "é" * 1001), (5, "e", None), (6, "f", " 　\t ")]
    df = papers(spark, rows, "seq bigint, paper_id string, key_results string")
    got = {r["seq"]: r["result"] for r in chains.build_chains(df, OPTS).collect()}
    assert got == {1: "x", 2: "y", 3: "​z", 4: "é" * 1000}


def test_a_missing_stage_column_leaves_no_chain(spark):
    df = papers(spark, [(1, "a")]).drop("key_results")
    assert chains.build_chains(df, OPTS).count() == 0


@pytest.mark.parametrize("value,want", [
    ("12345", 1234), ("c. 2019", 2019), ("n.d.", -1), ("0000", -1), ("2025-03-01", 2025),
    ("٢٠١٩", 2019), ("year ２０２１", 2021), (None, -1), ("", -1)])
def test_year_from_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "oa_year string")
    assert chains.parse_year(df, OPTS).first()["year"] == want


@pytest.mark.parametrize("text,number,want", [
    ("n.d.", 2025.0, 2025), (None, 2018.7, 2018), (None, float("nan"), -1),
    (None, float("inf"), -1), (None, None, -1), ("0000", 2018.7, -1), (None, -3.9, -3)])
def test_year_falls_back_to_the_second_column(spark, text, number, want):
    df = spark.createDataFrame([(text, number)], "oa_year string, source_year double")
    assert chains.parse_year(df, OPTS).first()["year"] == want


def test_field_names(spark):
    df = spark.createDataFrame([(" ",), (None,), (" bio ",)], "field_subfield string")
    assert [r["field"] for r in chains.normalise_field(df, OPTS).collect()] == [
        "unknown", "None", "bio"]
    assert chains.normalise_field(spark.range(1), OPTS).first()["field"] == "unknown"


def test_ids_and_citations(spark):
    rows = [(1, None, 3.9), (2, "x", -3.9), (3, "y", None)]
    df = papers(spark, rows, "seq bigint, paper_id string, oa_cited_by_count double")
    got = {r["seq"]: (r["id"], r["citations"]) for r in chains.build_chains(df, OPTS).collect()}
    assert got == {1: ("None", 3), 2: ("x", -3), 3: ("y", 0)}
    assert chains.build_chains(papers(spark, [(1, "a")]).drop("paper_id"), OPTS).first()["id"] == ""


def test_split_by_year_then_by_hash(spark):
    rows = [(2025, "a"), (2024, "a"), (1990, "b")] + [
        (y, f"P{k}") for y in (2030, -1) for k in range(2000)]
    df = chains.assign_split(spark.createDataFrame(rows, "year int, id string"), OPTS)
    got = df.collect()
    assert [r["split"] for r in got[:3]] == ["test", "train", "train"]
    share = sum(r["split"] == "test" for r in got[3:]) / 4000
    assert 0.08 < share < 0.12


def test_edge_pairs_and_long_range_edge(spark):
    df = spark.createDataFrame([("a", "b", "c", "d", "e", "f", "id1", 7)],
                               "title string, hypothesis string, method string, experiment string,"
                               "result string, conclusion string, id string, seq bigint")
    pairs = chains.edge_pairs(df)
    got = {(r["i"], r["j"]): (r["context"], r["target"]) for r in pairs.collect()}
    assert got[(2, 4)] == ("a b c", "e") and got[(0, 1)] == ("a", "b") and len(got) == 6
    off = Options(use_long_range_edge=False)
    assert {(r["i"], r["j"]) for r in chains.filter_edges(pairs, off).collect()} == \
        set(got) - {(2, 4)} == set(chains.edges_for(off))


def test_edge_dropout_skips_whole_groups(spark):
    pairs = spark.range(8000).select(
        (F.col("id") % 2000).alias("batch_id"), F.lit(0).alias("i"), F.lit(1).alias("j"))
    kept = chains.edge_dropout(pairs, 0.25, seed=3).groupBy("batch_id").count()
    counts = [r["count"] for r in kept.collect()]
    assert set(counts) == {4} and 1400 < len(counts) < 1600
    assert chains.edge_dropout(pairs, 0.0, seed=3).count() == 8000


def test_an_arrival_number_is_required(spark):
    with pytest.raises(ValueError, match="seq"):
        chains.build_chains(papers(spark, [(1, "a")]).drop("seq"), OPTS)
