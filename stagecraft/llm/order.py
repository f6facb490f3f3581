"""A total order of rows by id and text that ranges can be cut from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRACTION = 1 << 52
#: Above every id: where rows without one lie, spread by their hash.
_NO_ID, _NO_ID_WIDTH = 2e19, 1e18


def tie(text: str) -> Column:
    """52 bits of a hash of the text, which order rows of one id."""
    return F.xxhash64(text).bitwiseAND(F.lit(_FRACTION - 1))


def order_key(number: str, tied: str) -> Column:
    """A double that never decreases in the order (number, null last; tie).

    Rows of one id, or of none, differ in their tie, so cuts go through them as well.
    Beyond 2**53 rounding joins neighbours, which changes the balance of ranges only.
    """
    part = F.col(tied).cast("double") / _FRACTION
    return F.when(F.col(number).isNull(), _NO_ID + _NO_ID_WIDTH * part).otherwise(
        F.col(number).cast("double") + part)
