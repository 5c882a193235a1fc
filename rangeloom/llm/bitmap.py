"""A bitmap of hashed keys that keeps rows which a later join would drop out of its exchange."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest bitmap: 16 MB. What a filter lets through by mistake, a join or count drops.
MOST_BITS = 1 << 27


def likely(rows: DataFrame, keys: DataFrame, on: Sequence[str], most: int = MOST_BITS) -> DataFrame:
    """``rows`` whose ``on`` columns may stand in ``keys``; none that stands there is lost.

    The bitmap has 16 bits for each key, so 6 % of other rows pass, up to ``most`` bits; with more keys than that more
    rows pass, all of them in the end. It only saves an exchange, and what it gathers is bounded by ``most``.
    """
    n = keys.count()
    slots = min(most, max(1 << 12, 1 << (16 * n - 1).bit_length() if n else 0))
    slot = F.pmod(F.xxhash64(*on), F.lit(slots).cast("long"))
    one = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    found = one.toArrow()
    bitmap = np.zeros(slots // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()

    @F.pandas_udf("boolean")
    def there(s: pd.Series) -> pd.Series:
        at = s.to_numpy(np.int64)
        return pd.Series((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return rows.where(there(slot))
