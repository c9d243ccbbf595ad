"""A bitmap of fixed size that tells which keys can't be in a set.

It only spares work before an exact join: keys it lets through by chance are dropped there. Its size
(2**bits bits) doesn't depend on the data, so it may be shipped to every executor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def sieve(keys: DataFrame, hashed: str, bits: int = BITS) -> np.ndarray:
    """The bitmap of a long column of uniform hashes, built by aggregation; at most 2**(bits - 6) rows reach the driver."""
    h = F.shiftrightunsigned(hashed, 64 - bits)
    words = keys.select(F.shiftright(h, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {64 - bits}) & 63 as int))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def maybe(bitmap: np.ndarray, hashed: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For hashes as given to ``sieve``: whether each may be in the set."""
    h = hashed.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
