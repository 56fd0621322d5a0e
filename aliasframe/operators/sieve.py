"""A bitmap of hashes that tasks look keys up in before they put them out: what no one asks for is not shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a key, and the least and the most bits of a bitmap as powers of two: the largest takes 8 MB. Fuller ones let more through, never less.
SPARE, LEAST, MOST = 32, 16, 26


def sieve(hashes: DataFrame, rows: int) -> np.ndarray:
    """The bitmap of ``hashes(h)``, about ``rows`` of them: 64 bits an element, made by an aggregation; the driver gets each element once."""
    power = max(LEAST, min(MOST, (SPARE * max(rows, 1)).bit_length()))
    at = hashes.select(F.col("h").bitwiseAND(F.lit((1 << power) - 1)).alias("at"))
    filled = at.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << power - 6, np.uint64)
    out[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64 bits, signed or not) may be in the bitmap."""
    at = hashes.astype(np.uint64, copy=False) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
