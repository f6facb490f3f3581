import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagecraft.config import Options
from stagecraft.functions import text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [
    ("Improve and degrade", "degrade and degrade"),
    ("we degrade it", "we improve it"),
    ("non-significant", "non-negligible"),
    ("improves", "Contrary to the findings, improves"),
    ("improve_", "Contrary to the findings, improve_"),
    ("éimprove", "Contrary to the findings, éimprove"),
    ("elevated and REDUCED, reduce", "reduced and REDUCED, raise"),
    ("gain loss gain", "loss loss loss"),
    ("nothing here", "Contrary to the findings, nothing here"),
])
def test_flip(spark, value, want):
    assert one(spark, value, text.flip_findings) == want


def test_flip_agrees_with_a_stepwise_reading(spark):
    # Every pair of listed words with punctuation around: replacements must not cascade.
    words = [w for pair in text.FLIP_PAIRS for w in pair]
    rows = [f"{a}, ({b.upper()})-x {a}" for a in words for b in words]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r["t"]: r["f"] for r in df.select("t", text.flip_findings("t").alias("f")).collect()}
    for row in rows:
        want = row
        for left, right in text.FLIP_PAIRS:
            for old, new in ((left, right), (right, left)):
                changed = re.sub(rf"\b{old}\b", new, want, flags=re.I)
                if changed != want or re.search(rf"\b{old}\b", want, re.I):
                    want = changed
                    break
        assert got[row] == want


def test_strip_and_tokens_follow_python(spark):
    rows = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3101) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select("t", text.strip("t").alias("s"), text.tokens("t").alias("k")).collect()
    for r in got:
        assert r["s"] == r["t"].strip(), hex(ord(r["t"][0]))
        assert r["k"] == r["t"].split(), hex(ord(r["t"][0]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n　", max_size=12), min_size=1, max_size=8))
def test_truncation(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", text.truncate_tokens("t", 2).alias("x")).collect()}
    assert got == {i: " ".join(r.split()[:2]) for i, r in enumerate(rows)}


def test_markers_survive_truncation(spark):
    long = " ".join(f"w{k}" for k in range(1000))
    prompt = one(spark, long, lambda c: text.prediction_prompt(c, Options()))
    assert prompt.endswith(" w315 [PRED0][PRED1][PRED2][PRED3]")
    plain = one(spark, long, lambda c: text.prediction_prompt(c, Options(use_pred_tokens=False)))
    assert plain.split() == long.split()[:320]
