"""A set of 64-bit numbers as a bitmap of bounded size, to drop rows before they are joined.

The bitmap never loses a member; it may let others pass, which the join after it drops. It is built
in segments by the executors, and only its segments, of a fixed greatest size together, are sent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member, and the greatest size: 2^29 bits are 64 MB, whatever the number of members.
BITS_EACH = 16
MOST_BITS = 1 << 29
SEGMENT = 1 << 23


class Members:
    """Which numbers may be in the set."""

    def __init__(self, size: int, segments: dict[int, bytes]):
        self.size = size
        self.bits = np.zeros(size // 8, dtype=np.uint8)
        width = min(SEGMENT, size) // 8
        for number, held in segments.items():
            self.bits[number * width : (number + 1) * width] = np.frombuffer(held, dtype=np.uint8)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers.astype(np.int64).view(np.uint64) & np.uint64(self.size - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(members: DataFrame, column: str, most_bits: int = MOST_BITS) -> Broadcast:
    """The long `column` of `members` as a broadcast `Members`; nulls are left out."""
    spark = members.sparkSession
    numbers = members.select(F.col(column).alias("h")).where("h is not null")
    size = 1 << 16
    while size < min(numbers.count() * BITS_EACH, most_bits):
        size <<= 1
    width = min(SEGMENT, size)

    def segment(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(width, dtype=bool)
        flags[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"number": [key[0]], "held": [np.packbits(flags, bitorder="little").tobytes()]})

    at = F.col("h").bitwiseAND(F.lit(size - 1))
    places = numbers.select(F.floor(at / width).cast("long").alias("number"), (at % width).cast("long").alias("at")).distinct()
    rows = places.groupBy("number").applyInPandas(segment, "number long, held binary").collect()
    return spark.sparkContext.broadcast(Members(size, {r.number: bytes(r.held) for r in rows}))
