"""Raw paper rows to clean stage chains, their splits, and stage-to-stage pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagecraft.config import CHAIN_EDGES, LONG_RANGE_EDGE, STAGES, Options
from stagecraft.functions.hashing import digest, draw
from stagecraft.functions.text import full_text, prefix_context, strip, year_digits
from stagecraft.functions.vectors import hashed_counts, with_once

CHAIN_COLUMNS = (*STAGES, "id", "year", "citations", "field", "seq")
_FRACTIONS = (T.FloatType, T.DoubleType)


def _raw(df: DataFrame, column: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast("string")


def year_from(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """First year any of the columns yields; -1 when none does or the year is 0."""
    found = []
    for name in columns:
        if name not in df.columns:
            continue
        kind, value = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.StringType):
            found.append(year_digits(value))
        elif isinstance(kind, _FRACTIONS):
            whole = F.when(~F.isnan(value), value)
            found.append(F.when(F.abs(whole) < 2**31, whole).cast("int"))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            found.append(value.try_cast("int"))
    # A 0 from an earlier column is final: it does not fall through to the next one.
    return F.coalesce(F.nullif(F.coalesce(*found), F.lit(0)), F.lit(-1)) if found else F.lit(-1)


def parse_year(df: DataFrame, opts: Options) -> DataFrame:
    return df.withColumn("year", year_from(
        df, (opts.year_column, opts.fallback_year_column)))


def field_from(df: DataFrame, column: str) -> Column:
    """Trimmed field name; blank or absent is 'unknown', a null value is 'None'."""
    if column not in df.columns:
        return F.lit("unknown")
    name = strip(F.coalesce(F.col(column).cast("string"), F.lit("None")))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def normalise_field(df: DataFrame, opts: Options) -> DataFrame:
    return df.withColumn("field", field_from(df, opts.field_column))


def citations_from(df: DataFrame, column: str) -> Column:
    """Citation count truncated toward zero; null, absent or unreadable is 0."""
    if column not in df.columns:
        return F.lit(0).cast("bigint")
    value, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.StringType):
        value = strip(value)
    elif isinstance(kind, _FRACTIONS):
        value = F.when(~F.isnan(value), value)
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def build_chains(papers: DataFrame, opts: Options) -> DataFrame:
    """One row per paper with all six stages present; other papers are left out."""
    if opts.seq_column not in papers.columns:
        raise ValueError(f"papers need a unique arrival number in column {opts.seq_column!r}")
    stages = {stage: _raw(papers, column).cast("string")
              for stage, column in opts.stage_columns}
    complete = F.lit(True)
    for raw in stages.values():
        complete = complete & (strip(raw) != "")  # null is not complete either
    if opts.id_column in papers.columns:
        paper_id = F.coalesce(F.col(opts.id_column).cast("string"), F.lit("None"))
    else:
        paper_id = F.lit("")
    years = (opts.year_column, opts.fallback_year_column)
    return papers.where(complete).select(
        *[(strip(raw) if opts.max_stage_chars is None
           else F.substring(strip(raw), 1, opts.max_stage_chars)).alias(stage)
          for stage, raw in stages.items()],
        paper_id.alias("id"),
        year_from(papers, years).alias("year"),
        citations_from(papers, opts.citation_column).alias("citations"),
        field_from(papers, opts.field_column).alias("field"),
        F.col(opts.seq_column).cast("bigint").alias("seq"),
    )


def split_of(opts: Options) -> Column:
    """By year where the year decides, else by a fixed hash of the id."""
    bucket = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 1000
    by_hash = F.when(bucket / 1000.0 < opts.random_split_test_frac, "test").otherwise("train")
    year = F.col("year")
    return (F.when(year == opts.test_year, "test")
            .when((year != -1) & (year <= opts.train_cutoff_year), "train")
            .otherwise(by_hash))


def assign_split(chains: DataFrame, opts: Options) -> DataFrame:
    return chains.withColumn("split", split_of(opts))


def with_full_text(chains: DataFrame, out: str = "full_text") -> DataFrame:
    return chains.withColumn(out, full_text())


def with_context(chains: DataFrame, last_stage: int = 3, out: str = "ctx") -> DataFrame:
    return chains.withColumn(out, prefix_context(last_stage))


def edges_for(opts: Options) -> tuple:
    """The configured edges, without the long-range one if it is switched off."""
    return tuple(e for e in opts.chain_edges
                 if opts.use_long_range_edge or tuple(e) != LONG_RANGE_EDGE)


def edge_pairs(chains: DataFrame, edges: tuple = CHAIN_EDGES,
               context: Callable[[int], Column] = prefix_context) -> DataFrame:
    """Each chain times each edge (i, j): stages 0..i as context, stage j as target.

    The static edge list is exploded from a literal, so no join is needed. ``context`` joins
    the stages where their columns hold something else than text (see counted_stages).
    """
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                 context(i).alias("context"), F.col(STAGES[j]).alias("target"))
        for i, j in edges])
    kept = [c for c in chains.columns if c not in STAGES]
    return chains.select(*kept, F.inline(pairs))


def counted_stages(chains: DataFrame, opts: Options) -> DataFrame:
    """The chains with each stage's hashed_counts in place of its text."""
    counted = with_once(chains, *[hashed_counts(s, opts).alias(f"_{s}") for s in STAGES])
    return counted.select(*[c for c in chains.columns if c not in STAGES],
                          *[F.col(f"_{s}").alias(s) for s in STAGES])


def prefix_counts(opts: Options) -> Callable[[int], Column]:
    """prefix_context of counted_stages: the sums of the counts; a null stage adds nothing."""
    zeros = F.array_repeat(F.lit(0.0), opts.encoder_dim)

    def context(last_stage: int) -> Column:
        first, *others = [F.coalesce(F.col(s), zeros) for s in STAGES[: last_stage + 1]]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), others, first)

    return context


def filter_edges(pairs: DataFrame, opts: Options) -> DataFrame:
    if opts.use_long_range_edge:
        return pairs
    i, j = LONG_RANGE_EDGE
    return pairs.where(~((F.col("i") == i) & (F.col("j") == j)))


def edge_dropout(pairs: DataFrame, rate: float, seed: int) -> DataFrame:
    """Skip whole (batch, edge) groups with probability ``rate``; one draw per group."""
    bucket = draw("batch_id", "i", "j", seed) % 1_000_000
    return pairs.where(bucket / 1e6 >= rate)


def arrival_digest(seed: int) -> Column:
    return digest("id", "seq", seed)
