"""Seating of dishes with many customers in the Pitman-Yor model, against the whole recursion."""

import numpy as np
import pytest

from stagecraft.llm import pitman_yor, stirling
from stagecraft.scratch import batches_up_to


def text(seed, n):
    """Each word is mostly told by the one before."""
    draw, words, at = np.random.default_rng(seed), [], 0
    for _ in range(n):
        at = (at * 7 + 3) % 50 if draw.random() < 0.8 else int(draw.integers(0, 50))
        words.append(f"w{at}")
    return " ".join(words)


def conditional(count, others, parent, strength, d):
    """p(t) for t = 1..count."""
    score = pitman_yor.log_stirling(d, count)[count, 1:] + np.arange(1, count + 1) * np.log(parent)
    score += np.cumsum(np.log(strength + d * (others + np.arange(count))))
    weight = np.exp(score - score.max())
    return weight / weight.sum()


@pytest.mark.parametrize("d, others, parent", [(0.74, 3, 0.2), (0.74, 500, 0.05), (0.5, 40, 0.3)])
def test_a_sweep_seats_all_customers_of_a_large_dish(d, others, parent):
    count, n = pitman_yor.EXACT + 200, 600
    p, t = conditional(count, others, parent, 1.0, d), np.arange(1, count + 1)
    middle = (p * t).sum()
    spread = (p * t * t).sum() - middle * middle
    # One dish in each restaurant, so nothing but its own customers changes.
    last, mean = pitman_yor.gibbs(
        np.random.default_rng(2), np.arange(n), np.full(n, count), np.ones(n, np.int64), np.full(n, others),
        np.full(n, parent), 1.0, d, sweeps=5, burn=1)
    assert abs(last.mean() - middle) < 5 * (spread / n) ** 0.5
    # Four sweeps that seat everybody differ as four draws do.
    assert mean.var() < 0.4 * spread


@pytest.mark.parametrize("d", [0.1, 0.5, 0.74, 0.9])
def test_stirling_numbers_of_any_size(d):
    for count in (101, 1500):
        t = np.arange(1.0, count + 1)
        got = stirling.log_stirling_at(np.full(count, count), t, d)
        assert np.abs(got - pitman_yor.log_stirling(d, count)[count, 1:]).max() < 1e-6
    for count in (10**6, 10**9):
        t = np.unique(np.geomspace(2, count * 0.999, 50).round())
        same = np.full(len(t), count)
        want = np.logaddexp(stirling.log_stirling_at(same, t - 1, d),
                            stirling.log_stirling_at(same, t, d) + np.log(count - t * d))
        assert np.allclose(stirling.log_stirling_at(same + 1, t, d), want, rtol=1e-12, atol=1e-6)


@pytest.mark.parametrize("others, parent", [(0, 0.9999), (0, 1e-5), (3, 0.2), (500, 0.05), (10**5, 0.05), (10**5, 0.9)])
def test_draws_follow_the_exact_conditional(others, parent):
    count, n, d = 1500, 400, 0.74
    got = stirling.draw_many_tables(
        np.random.default_rng(3), np.full(n, count), np.full(n, others), np.full(n, parent), 1.0, d)
    seen = np.cumsum(np.bincount(got, minlength=count + 1)[1:]) / n
    assert np.abs(seen - np.cumsum(conditional(count, others, parent, 1.0, d))).max() < 2 / n**0.5


def test_draws_of_very_large_dishes():
    rng, n = np.random.default_rng(4), 30
    for count in (10**6, 10**10):
        few = stirling.draw_many_tables(rng, np.full(n, count), np.zeros(n), np.full(n, 1e-12), 1.0, 0.74)
        assert few.max() <= 2
    # Without other tables and under a sure parent the tables have no scale but count^d.
    wide = stirling.draw_many_tables(rng, np.full(n, 10**6), np.zeros(n), np.full(n, 0.99999), 1.0, 0.74)
    assert 10_000 < wide.mean() < 70_000 and len(set(wide.tolist())) > 20
    assert len(stirling.draw_many_tables(rng, *(np.zeros(0, np.int64),) * 3, 1.0, 0.74)) == 0


def test_scores_do_not_depend_on_where_the_table_of_numbers_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(i, text(i, 400)) for i in range(60)], "doc_id bigint, text string")
    by_table = {r.doc_id: r.score for r in pitman_yor.score_documents(docs).collect()}
    monkeypatch.setattr(pitman_yor, "EXACT", 120)
    beyond = {r.doc_id: r.score for r in pitman_yor.score_documents(docs).collect()}
    assert max(abs(beyond[i] / by_table[i] - 1) for i in range(60)) < 0.01
    assert abs(sum(beyond.values()) / sum(by_table.values()) - 1) < 1e-3


def test_small_batches_hold_only_inside(spark, conf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for own, inside in (("10000", "512"), ("10", "10"), ("0", "512")):
        conf(name, own)
        with batches_up_to(spark, 512):
            assert spark.conf.get(name) == inside
        assert spark.conf.get(name) == own
