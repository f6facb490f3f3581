import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import make_chains
from stagecraft.config import Options
from stagecraft.operators import pools, retrieval


def chain_rows(ids):
    return [(s, i, "test", "f", 1, f"result {i} {s} improve") for s, i in enumerate(ids)]


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_pools_with_a_hot_id(spark, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    # A third of all rows share one id; ids repeat elsewhere too.
    ids = ["copy"] * 40 + [f"P{k % 60}" for k in range(80)]
    df = make_chains(spark, chain_rows(ids))
    picks = pools.random_picks(df, 3, seed=2).collect()
    by_pool = {}
    for r in picks:
        by_pool.setdefault(int(r["pool_id"]), []).append(r["cand_seq"])
    assert set(by_pool) == set(range(120))
    for seq, chosen in by_pool.items():
        assert len(chosen) == len(set(chosen)) == 3
        assert all(ids[c] != ids[seq] for c in chosen)
    if partitions == "4":
        test_pools_with_a_hot_id.seen = sorted(map(tuple, picks))
    elif hasattr(test_pools_with_a_hot_id, "seen"):
        assert sorted(map(tuple, picks)) == test_pools_with_a_hot_id.seen
    circle = pools.hash_circle(df, 2).collect()
    assert sorted(r["idx"] for r in circle) == list(range(120))


def test_all_rows_of_the_other_id_are_reachable(spark):
    df = make_chains(spark, chain_rows(["a", "b", "b"]))
    got = Counter(r["pool_id"] for r in pools.random_picks(df, 3, seed=0).collect())
    assert got == {"0": 2, "1": 1, "2": 1}


@pytest.mark.parametrize("n,size", [(0, 2), (1, 2), (4, 5), (100, 6)])
def test_pool_sizes(spark, n, size):
    df = make_chains(spark, chain_rows([f"P{k}" for k in range(5)]))
    rows = pools.build_pools(df, n, seed=0).collect()
    kinds = Counter((r["pool_id"], r["kind"]) for r in rows)
    assert len(rows) == 5 * size
    for k in range(5):
        assert kinds[(str(k), "true")] == kinds[(str(k), "flip")] == 1
        assert sorted(r["pos"] for r in rows if r["pool_id"] == str(k)) == list(range(size))
    assert all(r["is_true"] == (r["kind"] == "true") for r in rows)


def test_one_chain_alone(spark):
    df = make_chains(spark, chain_rows(["only"]))
    assert {r["kind"] for r in pools.build_pools(df, 4, 0).collect()} == {"true", "flip"}


def test_positions_are_shuffled(spark):
    df = make_chains(spark, chain_rows([f"P{k}" for k in range(300)]))
    places = Counter(r["pos"] for r in pools.build_pools(df, 4, 0).where("is_true").collect())
    assert set(places) == set(range(5)) and min(places.values()) > 30


def okapi(query, docs):
    """BM25 of one pool, straight from the formula."""
    words = [d.lower().split() for d in docs]
    df = Counter(t for w in words for t in set(w))
    idf = {t: math.log(len(docs) - n + .5) - math.log(n + .5) for t, n in df.items()}
    floor = .25 * sum(idf.values()) / max(1, len(idf))
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    mean = sum(map(len, words)) / len(docs)
    scores = []
    for w in words:
        tf = Counter(w)
        scores.append(sum(
            idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (.25 + .75 * len(w) / mean))
            for q in query.lower().split()))
    return scores


def test_bm25_against_the_formula(spark):
    given = {
        "a": ("Alpha beta beta gamma", ["alpha beta", "BETA beta delta", "x y z", "gamma", "beta"]),
        "b": ("one two", ["three four", "five", "six seven"]),
        "c": ("same words", ["same words", "same words", "same"]),
    }
    pool_rows = [(p, k, "random", t, k == 0) for p, (_, docs) in given.items()
                 for k, t in enumerate(docs)]
    frame = spark.createDataFrame(
        pool_rows, "pool_id string, pos int, kind string, text string, is_true boolean")
    ctx = spark.createDataFrame([(p, q) for p, (q, _) in given.items()], "pool_id string, ctx string")
    got = {(r["pool_id"], r["pos"]): r["score"]
           for r in retrieval.bm25_scores(frame, ctx).collect()}
    want = {(p, k): s for p, (q, docs) in given.items() for k, s in enumerate(okapi(q, docs))}
    assert got == pytest.approx(want)


def test_ranking_ties_and_metrics(spark):
    rows = [("a", 0, False, 0.5), ("a", 1, True, 0.5), ("b", 0, True, 0.9), ("b", 1, False, 0.1)]
    scored = spark.createDataFrame(rows, "pool_id string, pos int, is_true boolean, score double")
    ranked = retrieval.rank_candidates(scored)
    assert {(r["pool_id"], r["pos"]): r["rank"] for r in ranked.collect()} == {
        ("a", 0): 1, ("a", 1): 2, ("b", 0): 1, ("b", 1): 2}
    m = retrieval.retrieval_metrics(ranked).first()
    assert (m["recall_at_1"], m["recall_at_5"], m["mrr"]) == (0.5, 1.0, 0.75)
    assert retrieval.bm25_recall(scored).first()["recall_at_1"] == 0.5


def test_dense_scores_with_a_custom_encoder(spark):
    df = make_chains(spark, chain_rows(["a", "b", "c"]))
    lengths = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    scored = retrieval.dense_scores(pools.build_pools(df, 3, 0), pools.contexts(df), Options(),
                                    encoder=lengths)
    assert all(0.99 < r["score"] <= 1.0000001 for r in scored.collect())


def test_bm25_tasks_grow_with_the_texts(spark, monkeypatch):
    """The exchange is cut by the tokens met, whatever spark.sql.shuffle.partitions is."""
    monkeypatch.setattr(retrieval, "TOKENS_PER_TASK", 100)
    want = None
    for repeats in (1, 10):
        frame = spark.createDataFrame(
            [(str(p), k, k == 0, f"a b{p} c{k} " * 25 * repeats) for p in range(10) for k in range(4)],
            "pool_id string, pos int, is_true boolean, text string")
        ctx = spark.createDataFrame([(str(p), "c0 c0 a") for p in range(10)], "pool_id string, ctx string")
        scored = retrieval.bm25_scores(frame, ctx)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        tasks = -(-(40 * 75 * repeats + 30) // 100)
        assert "Exchange hashpartitioning(pool_id#" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan
        ranks = sorted((r.pool_id, r.pos, r.rank) for r in retrieval.rank_candidates(scored).collect())
        want = want or ranks
        assert ranks == want and len(ranks) == 40


def test_bm25_sends_texts_and_not_arrays_of_tokens(spark, conf):
    """A task keeps all rows it sends, so they are about as large as the texts."""
    conf("spark.sql.adaptive.enabled", "false")
    texts = [" ".join(f"w{(n * 7 + k * k) % 90}" for k in range(400)) for n in range(40)]
    rows = [(str(n // 4), n % 4, n % 4 == 0, t) for n, t in enumerate(texts)] + [("0", 4, False, None)]
    frame = spark.createDataFrame(rows, "pool_id string, pos int, is_true boolean, text string")
    ctx = spark.createDataFrame([(str(p), texts[p * 4]) for p in range(10)], "pool_id string, ctx string")
    scored = retrieval.bm25_scores(frame, ctx)
    got = {(r.pool_id, r.pos): r.score for r in scored.collect()}
    assert len(got) == 41 and got["0", 4] == 0.0 and any(score != 0 for score in got.values())

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    sent = [n.metrics().apply("dataSize").value()
            for n in nodes(scored._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
    text_bytes = sum(len(r[3] or "") for r in rows) + sum(len(texts[p * 4]) for p in range(10))
    assert len(sent) == 1 and text_bytes < sent[0] < 1.5 * text_bytes
