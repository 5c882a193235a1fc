"""Column functions over record keys and job parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SIZE, VALUE_SIZE = 10, 90


def split_key(df: DataFrame, col: str, key_size: int = KEY_SIZE, value_size: int = VALUE_SIZE) -> DataFrame:
    """Add ``key`` (first bytes) and ``value`` (the bytes after them) of a BINARY record column."""
    return df.withColumns({"key": F.substring(col, 1, key_size), "value": F.substring(col, key_size + 1, value_size)})


def key_hex(key: Column) -> Column:
    """Two lower-case hex digits and a blank for each byte."""
    return F.regexp_replace(F.lower(F.hex(key)), "(..)", "$1 ")


def n_choose_r(k: str, r: str) -> Column:
    """Number of ``r``-subsets of ``k`` nodes (column names), null for r < 1 or r > k; each step divides evenly."""
    steps = f"aggregate(sequence(1L, greatest(cast({r} as bigint), 1L)), 1L, (a, i) -> a * ({k} - i + 1) div i)"
    return F.expr(f"case when {r} >= 1 and {r} <= {k} then {steps} end")


def masked_nodes(mask: Column, k: int) -> Column:
    """Sorted nodes 1..k of a bit mask; bit i-1 is node i."""
    return F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: F.getbit(mask, i - 1) == 1)


def _number(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("long")


def to_words(data: Column, size: int, prefix: str) -> dict[str, Column]:
    """BIGINT columns ``prefix0``, ``prefix1``... that carry a BINARY of ``size`` bytes, eight in each, the last ones padded with 0."""
    out = {}
    for i in range(-(-size // 8)):
        part = F.rpad(F.substring(data, 8 * i + 1, min(8, size - 8 * i)), 8, F.lit(b"\0"))
        out[f"{prefix}{i}"] = F.shiftleft(_number(F.substring(part, 1, 4)), 32).bitwiseOR(_number(F.substring(part, 5, 4)))
    return out


def from_words(words: Sequence[str], size: int) -> Column:
    """The BINARY of ``size`` bytes that :func:`to_words` has put in the columns ``words``."""
    return F.substring(F.unhex(F.concat(*(F.lpad(F.hex(F.col(w)), 16, "0") for w in words))), 1, size)
