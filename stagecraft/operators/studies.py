"""Study grids, summaries over seeds, and paired significance tests.

Run tables hold one row per (study, variant, seed): small, but grouped and windowed per
study all the same.
"""

from __future__ import annotations

import json
import math
from dataclasses import fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.significance import t_two_sided_p

# The loss weights and dropout rates that are studied.
LAMBDAS = (0.0, 0.25, 0.5, 1.0, 2.0)
DROPOUTS = (0.0, 0.125, 0.25, 0.5, 0.75)


def study_variants(name: str, base: Options = Options()) -> dict[str, Options]:
    """Variant name -> the whole options it runs with, for 'lambda', 'ablation' or 'dropout'."""
    if name == "lambda":
        return {str(w): base.but(edge_loss_weight=w, edge_loss_enabled=w > 0) for w in LAMBDAS}
    if name == "dropout":
        return {str(rate): base.but(loss_dropout=rate) for rate in DROPOUTS}
    if name != "ablation":
        raise ValueError(f"unknown study {name!r}")
    without = {"no_" + part: base.but(**{"use_" + option: False}) for part, option in (
        ("pred_tokens", "pred_tokens"), ("long_range_edge", "long_range_edge"),
        ("trivial_filter", "trivial_edge_filter"))}
    return {"full": base, **without, "mse_loss": base.but(edge_loss_type="mse"),
            "no_edge_loss": base.but(edge_loss_enabled=False)}


def overrides(variant: Options, base: Options = Options()) -> dict:
    """The options in which a variant differs from the base."""
    return {f.name: getattr(variant, f.name) for f in fields(base)
            if getattr(variant, f.name) != getattr(base, f.name)}


def study_grid(seeds: DataFrame, studies: tuple[str, ...], base: Options = Options()) -> DataFrame:
    """``study, variant, seed, settings``: every variant of the studies for every seed.

    The variant list is a literal exploded per seed row; ``settings`` maps the options that
    differ from ``base`` to JSON values.
    """
    variants = F.array(*[
        F.struct(F.lit(study).alias("study"), F.lit(variant).alias("variant"),
                 _settings(overrides(options, base)).alias("settings"))
        for study in studies for variant, options in study_variants(study, base).items()])
    return seeds.select("seed", F.inline(variants)).select(
        "study", "variant", "seed", "settings")


def _settings(changes: dict):
    pairs = [F.lit(x) for name, value in changes.items() for x in (name, json.dumps(value))]
    return F.create_map(*pairs).cast("map<string,string>")


def throughput(runs: DataFrame) -> DataFrame:
    return runs.withColumn("steps_per_sec", F.col("steps") / F.greatest(
        F.lit(1e-9), F.col("wall_time_s")))


def run_record(stats: DataFrame, metrics: DataFrame) -> DataFrame:
    """Training statistics and the six headline metrics of each run in one row."""
    key = ["study", "variant", "seed"]
    chosen = ["perplexity", "F1_recall1", "F1_bm25_recall1", "F2_rho",
              "mean_pairwise_cos", "effective_rank"]
    return stats.join(metrics.select(*key, *chosen), key)


def summarise_lambda(runs: DataFrame) -> DataFrame:
    """Means, population deviation and the perplexities in seed order, per variant."""
    by_seed = F.array_sort(F.collect_list(F.struct("seed", "perplexity")))
    return runs.groupBy("study", "variant").agg(
        F.avg("perplexity").alias("perplexity_mean"),
        F.stddev_pop("perplexity").alias("perplexity_std"),
        F.transform(by_seed, lambda s: s["perplexity"]).alias("perplexities"),
        F.avg("mean_pairwise_cos").alias("mean_pairwise_cos"),
        F.avg("effective_rank").alias("effective_rank"))


def summarise_ablation(runs: DataFrame) -> DataFrame:
    return runs.groupBy("study", "variant").agg(
        F.avg("perplexity").alias("perplexity_mean"),
        F.stddev_pop("perplexity").alias("perplexity_std"),
        F.avg("mean_pairwise_cos").alias("mean_pairwise_cos"))


def summarise_dropout(runs: DataFrame) -> DataFrame:
    return throughput(runs).groupBy("study", "variant").agg(
        F.avg("perplexity").alias("perplexity_mean"),
        F.avg("steps_per_sec").alias("steps_per_sec_mean"),
        F.avg("edges_run").alias("edges_run_mean"))


def pair_with_baseline(runs: DataFrame, baseline: str) -> DataFrame:
    """``study, variant, seed, value, base_value``: each run next to the baseline's run of
    the same seed."""
    is_base = F.col("variant") == baseline
    base = runs.where(is_base).select("study", "seed", F.col("perplexity").alias("base_value"))
    return runs.where(~is_base).select(
        "study", "variant", "seed", F.col("perplexity").alias("value")).join(
        base, ["study", "seed"]).select("study", "variant", "seed", "value", "base_value")


def paired_ttest(paired: DataFrame) -> DataFrame:
    """``study, variant, t_stat, p_value, value_mean, base_mean``.

    NaN with fewer than two pairs; without variance NaN for equal means, else p = 0.
    """
    gap = F.col("value") - F.col("base_value")
    sums = paired.groupBy("study", "variant").agg(
        F.count("*").alias("_n"), F.avg(gap).alias("_mean"), F.stddev_samp(gap).alias("_sd"),
        F.avg("value").alias("value_mean"), F.avg("base_value").alias("base_mean"))
    n, mean, sd = F.col("_n"), F.col("_mean"), F.col("_sd")
    nan = F.lit(math.nan)
    t = (F.when((n < 2) | sd.isNull() | F.isnan(sd) | F.isnan(mean), nan)
         .when(sd > 0, F.try_divide(mean, sd / F.sqrt(n)))
         .when(mean > 0, F.lit(math.inf)).when(mean < 0, F.lit(-math.inf))
         .otherwise(nan))
    return sums.withColumn("t_stat", t).select(
        "study", "variant", "t_stat", t_two_sided_p(F.col("t_stat"), n - 1).alias("p_value"),
        "value_mean", "base_mean")


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``significant_holm``: step-down Holm-Bonferroni within each study.

    A test passes while it and all smaller p-values pass; NaN counts as 1. The window holds
    one study's variants.
    """
    study = Window.partitionBy("study")
    ordered = study.orderBy("_p", "variant")
    p = F.when(F.col("p_value").isNull() | F.isnan("p_value"), 1.0).otherwise(F.col("p_value"))
    m = F.count("*").over(study)
    passes = F.col("_p") <= alpha / (m - F.row_number().over(ordered) + 1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (tests.withColumn("_p", p).withColumn("_passes", passes)
            .withColumn("significant_holm", F.every("_passes").over(so_far))
            .drop("_p", "_passes"))


def significance_report(runs: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """Paired test of every variant against the baseline; lower values are better."""
    tests = holm(paired_ttest(pair_with_baseline(runs, baseline)), alpha)
    better = F.col("value_mean") < F.col("base_mean")
    return tests.select("study", "variant", "p_value", "significant_holm",
                        better.alias("better_than_baseline"))
