"""Seeded draws that depend only on row values, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts) -> Column:
    """md5 hex of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in map(_col, parts)]))


def draw(*parts, hex_digits: int = 15) -> Column:
    """A non-negative BIGINT drawn from the leading hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), 1, hex_digits), 16, 10).cast("bigint")


def _col(part) -> Column:
    if isinstance(part, Column):
        return part
    return F.col(part) if isinstance(part, str) else F.lit(part)
