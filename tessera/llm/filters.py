"""Filters of fixed size that tell a pass over a table which keys are wanted, so that most other rows are spared a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB. A full filter lets too much through, never too little.
WORDS = 1 << 20


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each key (a long), combined before the shuffle; at most WORDS rows reach the driver."""
    h = F.col(column)
    mixed = keys.select((h.bitwiseXOR(F.shiftrightunsigned(h, 29)).bitwiseXOR(F.shiftrightunsigned(h, 43))).alias("h"))
    rows = mixed.selectExpr(f"h & {WORDS - 1}L AS w", "shiftleft(1L, cast(shiftrightunsigned(h, 20) & 63 AS int)) AS m").groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toArrow()
    table = np.zeros(WORDS, np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return table


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be wanted."""
    h = keys.view(np.uint64)
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(43))
    return (table[h & np.uint64(WORDS - 1)] >> ((h >> np.uint64(20)) & np.uint64(63)) & np.uint64(1)).astype(bool)
