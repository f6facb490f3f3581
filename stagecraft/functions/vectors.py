"""Column functions on vectors, and the default text encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.config import Options
from stagecraft.functions.text import prediction_prompt, tokens

Encoder = Callable[[Column], Column]


def with_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add aliased columns that are computed once per row.

    The one-row generator keeps filters on these columns (inferred join filters too) above
    it. Pushed into the scan, they would repeat the whole expression.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def dot(a, b) -> Column:
    """Inner product, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a, b) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(col) -> Column:
    """Scale to unit length; an all-zero vector stays zero."""
    # The norm is bound as an array element, so it is computed once and not per component.
    norm = F.array(F.sqrt(dot(col, col)))
    return F.element_at(F.transform(norm, lambda n: F.transform(col, lambda x: F.coalesce(
        F.try_divide(x.cast("double"), n), F.lit(0.0)))), 1)


def encode(df: DataFrame, text: str, out: str, opts: Options, *,
           limit: int | None = None, encoder: Encoder | None = None,
           counted: bool = False) -> DataFrame:
    """Add a unit vector of a text column, or of its hashed_counts if it is ``counted``.

    ``encoder`` may be any Column -> array<double> function, e.g. a pandas UDF or
    ``pyspark.ml.functions.predict_batch_udf``. The default hashes the
    lower-case tokens (the first ``limit``, if one is given) into signed buckets.
    """
    if counted:
        return with_once(df, l2_normalise(text).alias(out))
    if encoder is not None:
        return _encoded(df, F.col(text), out, encoder)
    return _hashed(df, text, out, opts.encoder_dim, limit)


def predict_stage(df: DataFrame, context: str, out: str, opts: Options, *,
                  encoder: Encoder | None = None, counted: bool = False) -> DataFrame:
    """Add the predicted vector of the next stage from its context.

    A learned ``encoder`` reads the marked prompt; the default one hashes the plain
    context (or takes its hashed_counts), because it has no use for marker tokens.
    """
    if counted:
        return encode(df, context, out, opts, counted=True)
    if encoder is not None:
        return _encoded(df, prediction_prompt(F.col(context), opts), out, encoder)
    return _hashed(df, context, out, opts.encoder_dim, None)


def hashed_counts(text, opts: Options) -> Column:
    """What the default encoder scales to unit length. Counts of texts joined by white space
    are the sums of their counts, so a text that stands in several is hashed once."""
    text = F.col(text) if isinstance(text, str) else text
    counts = _once(token_weights(tokens(F.lower(text)), opts.encoder_dim), lambda w: dense(w, opts.encoder_dim))
    return F.when(text.isNotNull(), counts)


def _encoded(df: DataFrame, text: Column, out: str, encoder: Encoder) -> DataFrame:
    # A column of its own below the generator: a Python function may not stand inside a lambda.
    return with_once(df.withColumn("_raw", encoder(text)), l2_normalise("_raw").alias(out)).drop("_raw")


def token_weights(words: Column, dim: int) -> Column:
    """Sparse counts of signed hash buckets: sorted (bucket from 0, weight), weight not 0.

    Each token is one code, bucket and sign. The codes are sorted and every run of a bucket
    becomes one entry, so the work follows the tokens and not the dimension.
    """
    def code(h):
        bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim
        return (bucket * 2 + (F.substring(h, 9, 1) < "8").cast("bigint")).cast("int")

    def runs(codes):
        n = F.size(codes)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(at, lambda i: (i == n - 1) | (
            F.shiftright(F.get(codes, i), 1) != F.shiftright(F.get(codes, i + 1), 1)))
        return _once(ends, lambda ends: F.transform(ends, lambda end, k: entry(codes, ends, end, k)))

    def entry(codes, ends, end, k):
        start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
        signs = F.aggregate(F.slice(codes, start + 1, end - start + 1), F.lit(0),
                            lambda total, c: total + 2 * (c % 2) - 1)
        return F.struct(F.shiftright(F.get(codes, end), 1).alias("bucket"), signs.cast("double").alias("weight"))

    hashes = F.transform(words, lambda token: F.md5(token))  # bound, so computed once a token
    counted = _once(F.sort_array(F.transform(hashes, code)), runs)
    return F.filter(counted, lambda e: e["weight"] != 0)


def unit_entries(entries: Column) -> Column:
    """Sparse entries scaled to unit length."""
    squares = F.aggregate(entries, F.lit(0.0), lambda total, e: total + e["weight"] * e["weight"])
    return _once(F.sqrt(squares), lambda norm: F.transform(entries, lambda e: F.struct(
        e["bucket"].alias("bucket"), (e["weight"] / norm).alias("weight"))))


def dense(entries: Column, dim: int) -> Column:
    """The array of ``dim`` numbers that sorted sparse entries stand for."""
    zero = F.lit(0.0)
    last = F.coalesce(F.get(entries, F.size(entries) - 1)["bucket"], F.lit(-1))

    def piece(e, k):
        before = F.when(k == 0, -1).otherwise(F.get(entries, k - 1)["bucket"])
        return F.concat(F.array_repeat(zero, e["bucket"] - before - 1), F.array(e["weight"]))

    return F.concat(F.flatten(F.transform(entries, piece)), F.array_repeat(zero, F.lit(dim - 1) - last))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound as an array element, so it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashed(df: DataFrame, text: str, out: str, dim: int, limit: int | None) -> DataFrame:
    words = tokens(F.lower(F.col(text)))
    weights = token_weights(words if limit is None else F.slice(words, 1, limit), dim)
    vector = _once(weights, lambda w: _once(unit_entries(w), lambda unit: dense(unit, dim)))
    return with_once(df, F.when(F.col(text).isNotNull(), vector).alias(out))
