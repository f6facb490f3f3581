"""Column functions on text: trimming, tokens, stage joins, flipped findings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagecraft.config import STAGES, Options

# Every code point Python's str.strip()/split() treats as white space (all are below U+3001).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WHITESPACE_RUN = "(?U)[\\s\\x1c-\\x1f]+"

# Decimal digits of other scripts, always in runs of ten from zero to nine.
_FOREIGN_DIGITS = "".join(
    chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"
)

# Antonym pairs for adversarial results, in the order they are tried.
FLIP_PAIRS = (
    ("improve", "degrade"), ("increase", "decrease"), ("higher", "lower"),
    ("better", "worse"), ("reduce", "raise"), ("outperform", "underperform"),
    ("gain", "loss"), ("boost", "hurt"), ("significant", "negligible"),
    ("positive", "negative"), ("effective", "ineffective"),
    ("associated", "unassociated"), ("elevated", "reduced"),
    ("upregulated", "downregulated"),
)
# Fixed value: what stands before a finding without such a word.
FLIP_PREFIX = "Contrary to the findings, "


def strip(col) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(col, F.lit(WHITESPACE))


def tokens(col) -> Column:
    """White-space tokens; the empty array for blank text."""
    return F.array_remove(F.split(col, _WHITESPACE_RUN), "")


def truncate_tokens(col, n: int) -> Column:
    """The first n white-space tokens, joined by single spaces."""
    return F.array_join(F.slice(tokens(col), 1, n), " ")


def full_text() -> Column:
    """All stages in order, joined by one space."""
    return F.concat_ws(" ", *STAGES)


def prefix_context(last_stage: int = 3) -> Column:
    """Stages 0..last_stage joined by one space (evaluation uses title..experiment)."""
    return F.concat_ws(" ", *STAGES[: last_stage + 1])


def prediction_prompt(col, opts: Options) -> Column:
    """Context text cut to the token budget, then the prediction markers.

    The markers are counted in the budget before cutting, so they always survive.
    """
    budget = opts.context_tokens
    if not opts.use_pred_tokens:
        return truncate_tokens(col, budget)
    k = opts.num_pred_tokens
    markers = "".join(f"[PRED{i}]" for i in range(k))
    return F.concat(truncate_tokens(col, budget - k), F.lit(" " + markers))


def year_digits(col) -> Column:
    """First run of four decimal digits in a string as an int, else null."""
    found = F.regexp_extract(col, r"\p{Nd}{4}", 0)
    ascii_digits = "0123456789" * (len(_FOREIGN_DIGITS) // 10)
    plain = F.translate(found, _FOREIGN_DIGITS, ascii_digits)
    return F.nullif(plain, F.lit("")).try_cast("int")


# Letters, digits and "_" of any script continue a word; combining marks do not.
_PIECES = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"
_FLIP_WORDS = tuple(w for pair in FLIP_PAIRS for w in pair)


def _plain(piece: Column) -> Column:
    """Lower case by way of upper case, so that variants of a letter meet."""
    return F.lower(F.upper(piece))


def has_flip_word(col) -> Column:
    words = F.transform(F.regexp_extract_all(col, F.lit(_PIECES)), _plain)
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in _FLIP_WORDS]))


def flip_findings(col) -> Column:
    """Swap antonyms so the text states the opposite finding.

    For each pair, the left word is replaced where it occurs; only where it does not
    occur is the right word replaced. The text is cut once into words and what lies between;
    the flip words it holds decide every pair's direction, and one pass writes the words
    anew. No pattern depends on the row.
    """
    original = F.col(col) if isinstance(col, str) else col
    flips = F.array(*[F.lit(w) for w in _FLIP_WORDS])
    partner = F.array(*[F.lit(w) for left, right in FLIP_PAIRS for w in (right, left)])

    def rewrite(pieces: Column) -> Column:
        found = F.array_intersect(F.transform(pieces, _plain), flips)
        return F.element_at(F.transform(F.array(found), lambda f: F.when(
            F.size(f) > 0, F.array_join(F.transform(pieces, lambda p: swap(p, f)), "")).otherwise(
            F.concat(F.lit(FLIP_PREFIX), original))), 1)

    def swap(piece: Column, found: Column) -> Column:
        # Places count from 1; left words stand at odd ones, their partners right after them.
        def turned(at: Column) -> Column:
            right_kept = (at % 2 == 0) & F.array_contains(found, F.element_at(partner, at))
            return F.when((at == 0) | right_kept, piece).otherwise(F.element_at(partner, F.greatest(at, F.lit(1))))

        place = F.array_position(flips, _plain(piece)).cast("int")
        short = F.length(piece) <= max(map(len, _FLIP_WORDS))
        return F.when(short, F.element_at(F.transform(F.array(place), lambda at: F.when(
            at > 0, turned(F.greatest(at, F.lit(1)))).otherwise(piece)), 1)).otherwise(piece)

    pieces = F.regexp_extract_all(original, F.lit(_PIECES))
    return F.element_at(F.transform(F.array(pieces), rewrite), 1)
