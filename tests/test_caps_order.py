import random

import pytest
from pyspark.sql import functions as F

from conftest import make_chains
from stagecraft.config import Options
from stagecraft.operators import caps, ordering, skew
from stagecraft.plans.dataset import capped

OPTS = Options(max_papers_per_field=7, max_train_examples=40, max_test_examples=15)


@pytest.fixture(scope="module")
def rows(spark):
    # Field "hot" holds most rows; arrival order is not the row order.
    rng = random.Random(5)
    data = [(s, f"P{s}", "test" if s % 4 == 0 else "train",
             "hot" if s % 3 else f"f{s % 9}", s % 11, f"text {s}") for s in range(600)]
    rng.shuffle(data)
    return make_chains(spark, data).persist()


def by_hand(data, opts, splits=True):
    seen, counts, kept = {}, {"train": 0, "test": 0}, set()
    limit = {"train": opts.max_train_examples, "test": opts.max_test_examples}
    for r in sorted(data, key=lambda r: r["seq"]):
        if r["split"] == "train":
            if seen.get(r["field"], 0) >= opts.max_papers_per_field:
                continue
            seen[r["field"]] = seen.get(r["field"], 0) + 1
        if splits and counts[r["split"]] >= limit[r["split"]]:
            continue
        counts[r["split"]] += 1
        kept.add(r["seq"])
    return kept


def seqs(df):
    found = [r["seq"] for r in df.select("seq").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_caps_match_a_sequential_pass(rows, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    data = rows.collect()
    wide = OPTS.but(max_train_examples=25, max_papers_per_field=20)
    assert seqs(caps.cap_per_field(rows, OPTS)) == by_hand(data, OPTS, splits=False)
    assert seqs(capped(rows, OPTS)) == by_hand(data, OPTS)
    assert seqs(caps.cap_per_split(caps.cap_per_field(rows, wide), wide)) == by_hand(data, wide)


def test_caps_off_and_above_the_data(rows):
    off = Options(max_train_examples=None, max_test_examples=None)
    high = Options(max_papers_per_field=10**6, max_train_examples=10**6, max_test_examples=10**6)
    assert capped(rows, off).count() == capped(rows, high).count() == 600
    assert capped(rows, off.but(max_test_examples=0)).where("split='test'").count() == 0


def test_large_limits_use_ranges(rows):
    assert seqs(caps.head_n(rows, 123)) == set(range(123))
    assert caps.head_n(rows, 5000).count() == 600
    assert caps.head_n(rows, 0).count() == 0


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_block_shuffle_permutes_inside_blocks(rows, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    got = ordering.block_shuffle(rows.repartition(5), 50, seed=1).select(
        "split", "seq", "order_pos").collect()
    moved = 0
    for split in ("train", "test"):
        arrival = sorted(r["seq"] for r in got if r["split"] == split)
        place = {r["seq"]: r["order_pos"] for r in got if r["split"] == split}
        assert sorted(place.values()) == list(range(len(arrival)))
        for k, seq in enumerate(arrival):
            assert place[seq] // 50 == k // 50
            moved += place[seq] != k
    assert moved > 500
    checks = sorted((r["seq"], r["order_pos"]) for r in got)[:5]
    if not hasattr(test_block_shuffle_permutes_inside_blocks, "seen"):
        test_block_shuffle_permutes_inside_blocks.seen = checks
    assert checks == test_block_shuffle_permutes_inside_blocks.seen


def test_workers_read_their_own_shards(rows):
    striped = {(r["split"], r["seq"]): r["worker"]
               for r in ordering.stripe(rows, 3, shard_rows=40).collect()}
    own = ordering.worker_order(rows, 3, 25, seed=1, shard_rows=40)
    batches = ordering.assign_batches(own, 8).collect()
    for split in ("train", "test"):
        arrival = sorted(r["seq"] for r in batches if r["split"] == split)
        for k, seq in enumerate(arrival):
            assert striped[(split, seq)] == k // 40 % 3
        for worker in range(3):
            mine = [r for r in batches if r["split"] == split and r["worker"] == worker]
            assert sorted(r["order_pos"] for r in mine) == list(range(len(mine)))
            stream = [s for k, s in enumerate(arrival) if k // 40 % 3 == worker]
            for r in mine:
                assert stream.index(r["seq"]) // 25 == r["order_pos"] // 25
                assert r["batch_id"] == r["order_pos"] // 8


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_running_total(spark, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 1000 - 500).cast("double").alias("k"),
        (F.col("id") % 5).alias("w"))
    data = df.collect()
    got = skew.running_total(df, "k", "before", weight=F.col("w"), group=["g"]).collect()
    assert len(got) == 1000
    for r in random.Random(1).sample(got, 60):
        assert r["before"] == sum(d["w"] for d in data if d["g"] == r["g"] and d["k"] < r["k"])


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_lookup_of_hot_keys(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    big = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0,
            F.concat(F.lit("k"), F.col("id") % 200)).alias("key"))
    lookup = big.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    lookup = lookup.withColumn("low", F.when(F.col("low") % 2 == 0, F.col("low")))
    got = skew.lookup_counted(big, lookup, ["key"]).collect()
    want = {r["key"]: r["low"] for r in lookup.collect()}
    assert len(got) == 3000 and all(r["low"] == want[r["key"]] for r in got)
