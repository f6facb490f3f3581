import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_chains
from stagecraft.config import Options
from stagecraft.functions import vectors
from stagecraft.functions.significance import t_two_sided_p
from stagecraft.operators import association, health, labels, lm, losses, skew, studies


def unit_rows(n, d, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vector_frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)],
                                 "i bigint, vec array<double>")


def test_health_against_the_full_matrix(spark):
    m = unit_rows(50, 8)
    df = vector_frame(spark, m).repartition(7)
    gram = m @ m.T
    want = (gram.sum() - np.trace(gram)) / (50 * 49)
    assert health.mean_pairwise_cos(df).first()[0] == pytest.approx(want, abs=1e-12)
    s = np.linalg.svd(m, compute_uv=False)
    p = s / s.sum()
    assert health.effective_rank(df).first()[0] == pytest.approx(
        math.exp(-(p * np.log(p + 1e-12)).sum()), abs=1e-9)


def test_health_edges(spark):
    few = vector_frame(spark, unit_rows(3, 4))
    assert math.isnan(health.mean_pairwise_cos(few).first()[0])
    assert math.isnan(health.effective_rank(few).first()[0])
    same = vector_frame(spark, np.repeat(unit_rows(1, 4), 6, axis=0))
    assert health.mean_pairwise_cos(same).first()[0] == pytest.approx(1.0)
    assert health.effective_rank(same).first()[0] == pytest.approx(1.0, abs=1e-5)


def test_edge_losses(spark):
    a, b = unit_rows(12, 5, 1), unit_rows(12, 5, 2)
    rows = [(k // 4, 0, 1, [float(x) for x in a[k]], [float(x) for x in (a if k < 4 else b)[k]])
            for k in range(12)]
    pairs = spark.createDataFrame(
        rows, "batch_id bigint, i int, j int, pred array<double>, true array<double>")
    cos = {r["batch_id"]: r for r in losses.edge_loss(pairs).collect()}
    mse = {r["batch_id"]: r for r in losses.edge_loss(pairs, "mse").collect()}
    for k in range(3):
        assert mse[k]["loss"] == pytest.approx(2 * cos[k]["loss"], abs=1e-12)
    kept = losses.drop_trivial_edges(losses.edge_loss(pairs))
    assert {r["batch_id"] for r in kept.collect()} == {1, 2}
    nll = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0)], "batch_id bigint, nll double")
    total = {r["batch_id"]: r["loss"] for r in losses.combined_loss(nll, kept, 0.5).collect()}
    assert total == pytest.approx({0: 3.0, 1: 2.0 + cos[1]["loss"] / 2, 2: 1.0 + cos[2]["loss"] / 2})
    assert losses.edges_run(pairs).first()[0] == 3


def test_encoder_is_unit_or_zero(spark):
    df = spark.createDataFrame([("Some words some",), ("   ",)], "t string")
    got = [r["v"] for r in vectors.encode(df, "t", "v", Options()).collect()]
    assert len(got[0]) == 64 and np.linalg.norm(got[0]) == pytest.approx(1.0)
    assert got[1] == [0.0] * 64


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_rank_statistics_against_brute_force(spark, conf, partitions):
    conf("spark.sql.shuffle.partitions", partitions)
    rng = random.Random(4)
    data = [(k, rng.randint(0, 12) / 4, 0 if k % 3 else rng.randint(0, 30), int(rng.random() < .3))
            for k in range(200)]
    df = spark.createDataFrame(data, "i bigint, s double, c bigint, label int")

    def ranks(xs):
        return [sum(o < x for o in xs) + (sum(o == x for o in xs) + 1) / 2 for x in xs]

    want = np.corrcoef(ranks([d[1] for d in data]), ranks([d[2] for d in data]))[0, 1]
    got = association.spearman(df, "s", "c", "i").first()
    assert got["spearman_rho"] == pytest.approx(want, abs=1e-12) and 0 < got["spearman_p"] <= 1
    pos, neg = [d[1] for d in data if d[3]], [d[1] for d in data if not d[3]]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert association.auroc(df, "label", "s").first()[0] == pytest.approx(wins, abs=1e-12)


def test_rank_statistics_without_spread(spark):
    df = spark.range(6).select(F.col("id").alias("i"), F.lit(1.0).alias("s"),
                               F.col("id").alias("c"), F.lit(1).alias("label"))
    got = association.spearman(df, "s", "c", "i").first()
    assert math.isnan(got["spearman_rho"]) and math.isnan(got["spearman_p"])
    assert math.isnan(association.auroc(df, "label", "s").first()[0])
    exact = association.spearman(df, "i", "c", "i").first()
    assert exact["spearman_rho"] == pytest.approx(1.0) and exact["spearman_p"] == pytest.approx(0.0)


def test_quartile_and_median_labels(spark):
    rows = [(k, f"P{k}", "test", "small", 100, "r") for k in range(3)]
    rows += [(10 + k, f"P{k}", "test", "equal", 5, "r") for k in range(4)]
    rows += [(20 + k, f"P{k}", "test", "wide", k, "r") for k in range(9)]
    df = make_chains(spark, rows)
    got = {r["seq"]: r["label"] for r in labels.citation_labels(df, Options()).collect()}
    thresh = np.quantile(np.log1p(np.arange(9.0)), 0.75)
    assert [got[k] for k in range(3)] == [0, 0, 0] and [got[10 + k] for k in range(4)] == [1] * 4
    assert [got[20 + k] for k in range(9)] == [int(math.log1p(k) >= thresh) for k in range(9)]
    four = make_chains(spark, [(k, "x", "test", "f", c, "r") for k, c in enumerate([1, 2, 2, 3])])
    median = labels.citation_labels(four, Options(label_strategy="median"))
    assert {r["seq"]: r["label"] for r in median.collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_log_citations_below_zero(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-2.0,)], "c double")
    a, b, c = [r[0] for r in df.select(labels.log_citations("c")).collect()]
    assert a == 0.0 and b == -math.inf and math.isnan(c)


def test_bigram_model_by_hand(spark):
    train = make_chains(spark, [(1, "a", "train", "f", 0, "u v u v w"), (2, "b", "train", "f", 0, "u")])
    test = make_chains(spark, [(3, "c", "test", "f", 0, "u v new w")])
    opts = Options(smoothing=0.5)
    texts = [[" ".join(r[s] for s in ("title", "hypothesis", "method", "experiment", "result",
                                      "conclusion")).split() for r in d.collect()]
             for d in (train, test)]
    pairs = Counter(p for t in texts[0] for p in zip(t, t[1:]))
    firsts = Counter(v for t in texts[0] for v in t[:-1])
    size = len({w for t in texts[0] for w in t}) + 1
    t = texts[1][0]
    want = np.mean([-math.log((pairs[p] + .5) / (firsts[p[0]] + .5 * size)) for p in zip(t, t[1:])])
    scored = lm.score_bigram(lm.fit_bigram(train), test, opts)
    assert scored.first()["nll"] == pytest.approx(want, abs=1e-12)
    assert lm.perplexity(scored).first()["perplexity"] == pytest.approx(math.exp(want))
    empty = lm.perplexity(scored.where("seq < 0")).first()
    assert (empty["perplexity"], empty["avg_nll"]) == (1.0, 0.0)


def test_t_distribution(spark):
    df = spark.createDataFrame([(t, n) for t in (0.0, 0.3, -2.5, 40.0) for n in (1, 2)],
                               "t double, n bigint")
    for r in df.select("t", "n", t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        t = abs(r["t"])
        want = 1 - 2 / math.pi * math.atan(t) if r["n"] == 1 else 1 - t / math.sqrt(2 + t * t)
        assert r["p"] == pytest.approx(want, abs=1e-12)
    def integrated(t, n):
        x = np.linspace(0, t, 200_001)
        log_scale = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - .5 * math.log(n * math.pi)
        density = np.exp(log_scale - (n + 1) / 2 * np.log1p(x * x / n))
        return 1 - 2 * np.trapezoid(density, x)

    points = spark.createDataFrame([(t, n) for t in (0.2, 1.0, 1.96, 4.0)
                                    for n in (3, 4, 5, 10, 31, 100, 999, 1000, 1001, 1250, 10**6)],
                                   "t double, n bigint")
    for r in points.select("t", "n", t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["p"] == pytest.approx(integrated(r["t"], r["n"]), abs=2e-9)
    # Closed forms without cancellation; at a billion degrees the tail is the normal one.
    tail = {(t, 1): 2 / math.pi * math.atan(1 / t) for t in (3.0, 1e6, 1e150)}
    tail |= {(t, 2): 2 / ((2 + t * t) * (1 + t / math.sqrt(2 + t * t))) for t in (9.0, 1e6, 1e100)}
    tail |= {(t, 10**12): math.erfc(t / math.sqrt(2)) for t in (0.5, 9.0, 13.0, 30.0)}
    points = spark.createDataFrame(list(tail), "t double, n bigint")
    for r in points.select("t", "n", t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["p"] == pytest.approx(tail[r["t"], r["n"]], rel=1e-6, abs=0)
    odd = spark.createDataFrame([(None, 3), (float("nan"), 3), (1.0, 0)], "t double, n bigint")
    assert all(math.isnan(r[0]) for r in odd.select(t_two_sided_p(F.col("t"), F.col("n"))).collect())


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_null_fields_and_scores(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    rows = [(k, [None, " ", "unknown", "f"][k % 4], k) for k in range(20)]
    chains = spark.createDataFrame(rows, "seq bigint, field string, citations bigint")
    got = labels.citation_labels(chains, Options()).collect()
    unknown = [c for _, f, c in rows if f != "f"]
    assert len(got) == 20 and all(
        r["label"] == (r["citations"] >= np.quantile(unknown, 0.75)) for r in got if r["field"] != "f")
    scores = spark.createDataFrame([(k, None if k < 4 else float(k), float(k % 5)) for k in range(20)],
                                   "id bigint, x double, y double")
    with_nulls = association.spearman(scores, "x", "y", "id").first()
    assert with_nulls == association.spearman(scores.where("x IS NOT NULL"), "x", "y", "id").first()
    assert with_nulls["n"] == 16
    tiny = spark.createDataFrame([(k * 1e-8, int(k == 1)) for k in (1, 2, 3, 4)] + [(None, 1)],
                                 "s double, positive int")
    assert association.auroc(tiny, "positive", "s").first()["auroc"] == 0.0


def runs_frame(spark, values):
    rows = [("s", v, k, float(x)) for v, xs in values.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "study string, variant string, seed int, perplexity double")


def test_paired_tests(spark):
    runs = runs_frame(spark, {"base": [1, 2, 3], "up": [2, 3, 4], "same": [1, 2, 3],
                              "mixed": [2, 2.5, 3.1], "short": [1]})
    got = {r["variant"]: r for r in
           studies.paired_ttest(studies.pair_with_baseline(runs, "base")).collect()}
    assert got["up"]["p_value"] == 0.0 and got["up"]["t_stat"] == math.inf
    assert math.isnan(got["same"]["p_value"]) and math.isnan(got["short"]["p_value"])
    gaps = np.array([1, .5, .1])
    t = gaps.mean() / (gaps.std(ddof=1) / math.sqrt(3))
    assert got["mixed"]["p_value"] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
    report = {r["variant"]: r for r in studies.significance_report(runs, "base").collect()}
    assert report["up"]["significant_holm"] and not report["same"]["significant_holm"]
    assert not report["up"]["better_than_baseline"]


def test_holm_stops_at_the_first_failure(spark):
    ps = [.01, .04, .03, .2, float("nan")]
    tests = spark.createDataFrame([("s", f"v{k}", p) for k, p in enumerate(ps)],
                                  "study string, variant string, p_value double")
    got = {r["variant"]: r["significant_holm"] for r in
           studies.holm(tests.where("variant != 'v4'")).collect()}
    assert got == {"v0": True, "v1": False, "v2": False, "v3": False}
    assert not any(r["significant_holm"] for r in
                   studies.holm(tests.where("variant = 'v4'")).collect())


def test_summaries_and_grid(spark):
    runs = runs_frame(spark, {"a": [3, 1, 2]}).withColumns({
        "mean_pairwise_cos": F.lit(0.5), "effective_rank": F.lit(2.0),
        "steps": F.lit(10), "wall_time_s": F.lit(0.0), "edges_run": F.col("seed")})
    row = studies.summarise_lambda(runs).first()
    assert row["perplexities"] == [3, 1, 2] and row["perplexity_mean"] == 2
    assert row["perplexity_std"] == pytest.approx(np.std([3, 1, 2]))
    drop = studies.summarise_dropout(runs).first()
    assert drop["steps_per_sec_mean"] == pytest.approx(1e10) and drop["edges_run_mean"] == 1
    grid = studies.study_grid(spark.range(3).toDF("seed"), ("lambda", "ablation", "dropout")).collect()
    assert len(grid) == 3 * 16
    zero = next(r for r in grid if r["study"] == "lambda" and r["variant"] == "0.0")
    assert zero["settings"]["edge_loss_enabled"] == "false"


def test_the_models_own_documents_score_alike_on_its_buckets(spark):
    """score_fitted answers from the model's buckets, without an exchange of the model; the
    losses are those of the general path and of a count by hand. One pair stands in all rows."""
    texts = [f"the same w{i % 7} the same w{i % 3} end{i}" for i in range(60)]
    stages = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
    chains = spark.createDataFrame(
        [(i, *(text if s == "result" else "x" for s in stages)) for i, text in enumerate(texts)],
        "seq bigint, " + ", ".join(f"{s} string" for s in stages))
    opts = Options()
    model = lm.fit_bigram(chains)
    scored = lm.score_fitted(model, chains, opts)
    got = {r.seq: r.nll for r in scored.collect()}
    general = {r.seq: r.nll for r in lm.score_bigram(model, chains, opts).collect()}

    words = [["x"] * 4 + t.split() + ["x"] for t in texts]
    pairs = Counter(p for w in words for p in zip(w, w[1:]))
    firsts = Counter(v for w in words for v in w[:-1])
    size = len({t for w in words for t in w}) + 1
    for seq, w in enumerate(words):
        losses = [-math.log((pairs[p] + 1) / (firsts[p[0]] + size)) for p in zip(w, w[1:])]
        assert math.isclose(got[seq], sum(losses) / len(losses), rel_tol=1e-9)
        assert math.isclose(general[seq], got[seq], rel_tol=1e-9)
    assert {r.v + " " + r.w: (r.n, r.first_n) for r in model.pairs.collect()} == {
        f"{v} {w}": (n, firsts[v]) for (v, w), n in pairs.items()}
    assert model.pairs.count() == len(pairs)


def test_cold_pairs_meet_the_models_buckets_without_an_exchange_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    stages = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
    chains = spark.createDataFrame(
        [(i, *(f"a b t{i}{s[0]}" for s in stages)) for i in range(300)],
        "seq bigint, " + ", ".join(f"{s} string" for s in stages))
    model = lm.fit_bigram(chains)
    scored = lm.score_fitted(model, chains, Options())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    assert "Bucketed: true" in join
    assert "hashpartitioning(v#" in join and "hashpartitioning(_key_v" not in plan
    monkeypatch.undo()
    want = {r.seq: r.nll for r in lm.score_fitted(model, chains, Options()).collect()}
    assert {r.seq: round(r.nll, 9) for r in scored.collect()} == {s: round(n, 9) for s, n in want.items()}


def test_the_bigram_model_is_counted_with_two_exchanges(spark, monkeypatch):
    """Perplexity and losses need no first_n on the pairs; they agree with a count by hand when
    every lookup is joined, last words and unknown ones included."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    stages = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
    schema = "seq bigint, " + ", ".join(f"{s} string" for s in stages)
    train = spark.createDataFrame([(i, *["a"] * 5, f"a b w{i % 3} end{i}") for i in range(20)], schema)
    test = spark.createDataFrame([(i, *["a"] * 5, f"new b w{i} end1 end{i} x") for i in range(5)]
                                 + [(9, *[""] * 6), (10, *[""] * 5, "one")], schema)
    asked = []
    monkeypatch.setattr(lm, "lookup_counted", lambda *a, **k: asked.append(a) or skew.lookup_counted(*a, **k))
    model = lm.fit_bigram(train)
    got = lm.corpus_perplexity(model, test, Options()).first()
    assert not asked  # the counts alone answer
    words = [["a"] * 5 + f"a b w{i % 3} end{i}".split() for i in range(20)]
    pairs, firsts = Counter(p for w in words for p in zip(w, w[1:])), Counter(v for w in words for v in w[:-1])
    size = len({t for w in words for t in w}) + 1
    assert model.size == size and model.vocabulary.count() == size - 1
    assert {(r.v, r.w): r.n for r in model.counts.collect()} == dict(pairs)

    def loss(w):
        return np.mean([-math.log((pairs[p] + 1) / (firsts[p[0]] + size)) for p in zip(w, w[1:])])

    want = {i: loss(["a"] * 5 + f"new b w{i} end1 end{i} x".split()) for i in range(5)}
    assert got["avg_nll"] == pytest.approx(np.mean(list(want.values())), rel=1e-12)
    assert {r.seq: r.nll for r in lm.score_bigram(model, test, Options()).collect()} == pytest.approx(want, rel=1e-12)


def test_edge_losses_hash_each_stage_once(spark):
    """Contexts are sums of their stages' counts; vectors and losses are those of the texts."""
    from stagecraft.config import CHAIN_EDGES
    from stagecraft.functions.vectors import encode, predict_stage
    from stagecraft.operators import chains as chain_ops
    from stagecraft.plans import evaluation

    stages = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
    rows = [(i, i // 4, *[f"{s} word{i % 5} Word{k} ΣΣ w{i * k} x" for k, s in enumerate(stages)]) for i in range(40)]
    rows += [(90, 9, None, "", "a a b", " ", None, "a"), (91, 9, *[None] * 6)]
    df = spark.createDataFrame(rows, "seq bigint, batch_id bigint, " + ", ".join(f"{s} string" for s in stages))
    opts = Options()
    texts = chain_ops.edge_pairs(df)
    old = encode(predict_stage(texts, "context", "pred", opts), "target", "true", opts)
    new = chain_ops.edge_pairs(chain_ops.counted_stages(df, opts), CHAIN_EDGES, chain_ops.prefix_counts(opts))
    new = encode(predict_stage(new, "context", "pred", opts, counted=True), "target", "true", opts, counted=True)

    def vectors(pairs):
        return {(r.seq, r.i, r.j): (r.pred, r.true) for r in pairs.collect()}

    assert vectors(new) == vectors(old) and len(vectors(new)) == 42 * 6
    losses_ = evaluation.batch_edge_losses(df, opts.but(loss_dropout=0.0))
    plan = losses_._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("md5(") <= len(stages) + 1  # one more for the dropout's draw
    assert losses_.count() == 6 * 10


@pytest.mark.parametrize("own, tasks", [("128m", 4), ("10k", 8)])
def test_pairs_are_counted_in_splits_of_bounded_size(spark, conf, monkeypatch, tmp_path, own, tasks):
    """The table of distinct pairs that a task holds does not grow with the session's splits; a
    smaller limit of the session holds, and its own value is back afterwards."""
    stages = ("title", "hypothesis", "method", "experiment", "result", "conclusion")
    schema = "seq bigint, " + ", ".join(f"{s} string" for s in stages)
    texts = [" ".join(f"w{(i * 31 + k * k) % 977}" for k in range(200)) for i in range(400)]
    rows = spark.createDataFrame([(i, *["a"] * 5, t) for i, t in enumerate(texts)], schema)
    rows.repartition(8).write.option("compression", "none").parquet(str(tmp_path / "chains"))
    size = sum(f.stat().st_size for f in (tmp_path / "chains").glob("*.parquet"))
    conf("spark.sql.files.minPartitionNum", "1")
    conf("spark.sql.files.openCostInBytes", "0")
    conf("spark.sql.files.maxPartitionBytes", own)
    monkeypatch.setattr(lm, "SPLIT_BYTES", size // 4, raising=False)
    chains = spark.read.schema(schema).parquet(str(tmp_path / "chains"))

    def widest(group, job):
        """The most tasks of a stage of the jobs run meanwhile."""
        sc = spark.sparkContext
        sc.setJobGroup(group, "counting")
        done, tracker = job(), sc.statusTracker()
        sc.setLocalProperty("spark.jobGroup.id", None)
        first = min(tracker.getJobIdsForGroup(group))
        return done, tracker.getStageInfo(min(tracker.getJobInfo(first).stageIds)).numTasks

    model, fitted = widest(f"fit-{own}", lambda: lm.fit_bigram(chains))
    scored, met = widest(f"score-{own}", lambda: lm.corpus_perplexity(model, chains, Options()))
    assert fitted >= tasks and met >= tasks
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == own
    words = [["a"] * 5 + t.split() for t in texts]
    pairs = Counter(p for w in words for p in zip(w, w[1:]))
    firsts, size = Counter(v for w in words for v in w[:-1]), len({t for w in words for t in w}) + 1
    assert {(r.v, r.w): r.n for r in model.counts.collect()} == dict(pairs)
    want = np.mean([np.mean([-math.log((pairs[p] + 1) / (firsts[p[0]] + size)) for p in zip(w, w[1:])]) for w in words])
    assert scored.first()["avg_nll"] == pytest.approx(want, rel=1e-9)
