"""Long exact spans shared between records, by super-k-mer partitioning.

Every window of `length` characters has a minimiser, the least hash of the short substrings in it.
Consecutive windows with the same minimiser overlap in all but one character each, so they travel
as one packed string (a super-k-mer) to the minimiser's bucket instead of as windows of their own.
Equal windows have equal minimisers, so they meet in one bucket. There the windows of the packed
strings are sorted by a hash of 128 bits and counted; what leaves a bucket is intervals.

1. The owners of each minimiser are found first. Buckets of one owner hold nothing shared; the others
   go into a bitmap of bounded size, and only strings that pass it are packed and moved.
2. Equal packed strings are one string with several owners, so copies take no room in a bucket.
3. A bucket with too many windows for one task is split by a second minimiser; should that not be
   enough, its windows are counted as rows.
4. The intervals go back to the records that hold the string, and are joined to runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.sketch import bitmap
from skein.session import cut

#: Shortest length of spans that can be asked for.
LEAST_LENGTH = 12
#: Windows packed in one string at most. A longer run of one minimiser is cut; all of its
#: pieces go to the same bucket.
PACK = 512
#: Windows that one task sorts at once; a bucket with more is split.
MOST_WINDOWS = 1 << 21
#: How often a bucket is split by a further minimiser before its windows become rows.
LEVELS = 2


def seed_of(length: int) -> int:
    """Characters of the substrings hashed for minimisers: the power of two between a sixth and a third.

    Long ones tell passages apart: few texts share one by chance, so few buckets have to be counted.
    """
    return 1 << int(np.log2(length / 3))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(codes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of the `size` code points (a power of two) from each place on: of 2n characters from two of n."""
    h, span = _mix(codes.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 1) % 2**64)), 1
    while span < size:
        h = _mix(h[:-span] * np.uint64(0xD6E8FEB86659FD93) + h[span:])
        span *= 2
    return h


def _windows(codes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A hash of the `length` code points from each place on: two overlapping parts cover them."""
    size = 1 << (length.bit_length() - 1)
    h = _rolled(codes, size, salt)
    return _mix(h[: len(codes) - length + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[length - size :])


def _minimisers(codes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The minimiser's hash for each window of `length` code points, in one pass each."""
    seed = seed_of(length)
    h = _rolled(codes, seed, salt)
    width = length - seed + 1
    # least of each `width` neighbours: suffix minima of one block, prefix minima of the next
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(text: str, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, end) of the runs of windows with one minimiser."""
    codes = _codes(text)
    if len(codes) < length:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    least = _minimisers(codes, length, salt).view(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[starts], starts, np.append(starts[1:], len(least))


def super_kmers(text: str, length: int, salt: int = 0, members=None) -> Iterator[tuple[int, int, str]]:
    """(minimiser, first window's start, packed string) of the runs of windows with one minimiser; only those in `members` if given."""
    least, starts, ends = _runs(text, length, salt)
    if members is not None and len(least):
        keep = members(least)
        least, starts, ends = least[keep], starts[keep], ends[keep]
    for minimiser, start, end in zip(least.tolist(), starts.tolist(), ends.tolist()):
        for at in range(start, end, PACK):
            last = min(at + PACK, end)
            yield minimiser, at, text[at : last - 1 + length]


def _owners(length: int):
    def owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(np.unique(_runs(text, length)[0]), block) for block, text in zip(pdf["block_id"], pdf["text"])]
            least = np.concatenate([least for least, _ in parts]) if parts else np.empty(0, dtype=np.int64)
            blocks = np.repeat(np.array([block for _, block in parts], dtype=np.int64), [len(least) for least, _ in parts]) if parts else least
            yield pd.DataFrame({"minimiser": least, "block_id": blocks})

    return owners


def _pack(length: int, members):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.block_id, r.field, r.tid, minimiser, start, packed)
                for r in pdf.itertuples(index=False)
                for minimiser, start, packed in super_kmers(r.text, length, 0, members.value)
            ]
            yield pd.DataFrame(rows, columns=["block_id", "field", "tid", "minimiser", "start", "packed"])

    return pack


def _repack(length: int, salt: int):
    def repack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for minimiser, start, packed in super_kmers(r.packed, length, salt):
                    both = _mix(np.array([r.minimiser, minimiser], dtype=np.int64).view(np.uint64))
                    rows.append((r.a, r.b, r.low, r.high, int((both[0] * np.uint64(3) + both[1]).view(np.int64)), start, packed))
            yield pd.DataFrame(rows, columns=["pa", "pb", "low", "high", "minimiser", "start", "packed"])

    return repack


def _shared_in(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Intervals of shared windows of the strings of whole buckets: a, b, first, last (windows, last exclusive)."""
    texts = pdf["packed"].tolist()
    codes = _codes("".join(texts))
    sizes = np.array([len(t) for t in texts])
    counts = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = offsets[owner] + inside
    h1, h2 = _windows(codes, length, 1)[place], _windows(codes, length, 2)[place]
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    heads = np.flatnonzero(np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))))
    low, high = pdf["low"].to_numpy()[owner][order], pdf["high"].to_numpy()[owner][order]
    several = np.minimum.reduceat(low, heads) != np.maximum.reduceat(high, heads)
    shared = np.empty(len(owner), dtype=bool)
    shared[order] = np.repeat(several, np.diff(np.append(heads, len(order))))
    # runs of shared windows, ended by the string's end
    opens = shared & np.concatenate(([True], (~shared[:-1]) | (owner[1:] != owner[:-1])))
    closes = shared & np.concatenate(((~shared[1:]) | (owner[1:] != owner[:-1]), [True]))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    who = owner[first]
    return pd.DataFrame({"a": pdf["a"].to_numpy()[who], "b": pdf["b"].to_numpy()[who], "first": inside[first], "last": inside[last] + 1})


def _count(length: int, most: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:  # sorted by minimiser: buckets are whole but for the last
            held.append(pdf)
            size += int(pdf["packed"].str.len().sum()) - len(pdf) * (length - 1)
            if size >= most:
                rows = pd.concat(held, ignore_index=True)
                ready = (rows["minimiser"] != rows["minimiser"].iloc[-1]).to_numpy()
                if ready.any():
                    yield _shared_in(rows[ready].reset_index(drop=True), length)
                    rows = rows[~ready]
                held, size = [rows], int(rows["packed"].str.len().sum()) - len(rows) * (length - 1)
        if size:
            yield _shared_in(pd.concat(held, ignore_index=True), length)

    return count


def _named(df: DataFrame) -> DataFrame:
    """Strings with an id of 128 bits."""
    return df.withColumn("a", F.xxhash64("packed")).withColumn("b", F.xxhash64(F.lit(1), "packed"))


def _as_rows(strings: DataFrame, length: int) -> DataFrame:
    """What `_shared_in` gives, counted as one row a window, combined before it is exchanged."""
    cuts = F.transform(F.sequence(F.lit(0), F.length("packed") - length), lambda i: F.substring("packed", i + 1, F.lit(length)))
    rows = strings.select("a", "b", "low", "high", F.posexplode(cuts).alias("i", "w")).select("a", "b", "low", "high", "i", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"))
    shared = rows.groupBy("h1", "h2").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h")
    hits = rows.join(shared.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return hits.select("a", "b", F.col("i").cast("long").alias("first"), (F.col("i") + 1).cast("long").alias("last"))


def _intervals(strings: DataFrame, length: int, most: int, level: int = 1) -> DataFrame:
    """Shared windows of distinct strings (minimiser, a, b, low, high, packed): a, b, first, last."""
    sizes = strings.groupBy("minimiser").agg(F.sum(F.length("packed") - (length - 1)).alias("windows"))
    hot = cut(sizes.where(F.col("windows") > most).select("minimiser"))
    plain = strings.join(hot, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser")
    out = plain.select("minimiser", "a", "b", "low", "high", "packed").mapInPandas(_count(length, most), "a long, b long, first long, last long")
    if hot.isEmpty():
        return out
    full = strings.join(hot, "minimiser", "left_semi")
    if level > LEVELS:
        return out.unionByName(_as_rows(full, length))
    parts = cut(_named(full.mapInPandas(_repack(length, level), "pa long, pb long, low long, high long, minimiser long, start long, packed string")))
    smaller = cut(_distinct(parts))
    found = parts.select("pa", "pb", "start", "a", "b").join(_intervals(smaller, length, most, level + 1), ["a", "b"])
    return out.unionByName(found.select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")))


def _distinct(parts: DataFrame) -> DataFrame:
    return parts.groupBy("minimiser", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("packed").alias("packed"))


def _records(blocks: DataFrame) -> DataFrame:
    """(block_id, field, text) of what can hold a span."""
    field = lambda name: blocks.select("block_id", F.lit(name).alias("field"), F.col(name).alias("text"))
    return field("content").unionByName(field("text")).where(F.col("block_id").isNotNull())


def shared_spans(blocks: DataFrame, length: int = 200, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Maximal runs of shared positions: block_id, field, start_pos, end_pos.

    A position is shared if it lies in a string of at least `length` characters that also occurs,
    character for character, in the `content` or `text` of a block with another block_id. A block
    given twice is one block; what it repeats only in itself isn't shared. Null and short texts hold
    no span; an empty table has none.
    """
    if length < LEAST_LENGTH:
        raise ValueError(f"length must be at least {LEAST_LENGTH}")
    records = _records(blocks).where(F.length("text") >= length).withColumn("tid", F.xxhash64("text"))
    owners = records.select("block_id", "text").mapInPandas(_owners(length), "minimiser long, block_id long")
    several = cut(owners.groupBy("minimiser").agg(F.min("block_id").alias("l"), F.max("block_id").alias("h")).where("l <> h").select("minimiser"))
    packed = records.select("block_id", "field", "tid", "text").mapInPandas(_pack(length, bitmap(several, "minimiser")), "block_id long, field string, tid long, minimiser long, start long, packed string")
    held = cut(_named(packed))
    strings = cut(_distinct(held.withColumn("low", F.col("block_id")).withColumn("high", F.col("block_id"))))
    places = held.select("block_id", "field", "tid", "start", "a", "b").distinct()
    hits = places.join(_intervals(strings, length, most_windows), ["a", "b"])
    hits = hits.select("block_id", "field", "tid", (F.col("start") + F.col("first")).alias("at"), (F.col("start") + F.col("last") - 1 + length).alias("to"))
    w = Window.partitionBy("block_id", "field", "tid").orderBy("at")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("fresh", F.when(F.col("at") <= reach, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("block_id", "field", "tid", "run")
    return runs.agg(F.min("at").alias("start_pos"), F.max("to").alias("end_pos")).select("block_id", "field", "start_pos", "end_pos")


def shared_share(blocks: DataFrame, length: int = 200) -> DataFrame:
    """For every block and filled field: block_id, field, chars, shared_chars, shared_share.

    Blocks without shared spans have 0; empty texts have the share 0.
    """
    spans = shared_spans(blocks, length).groupBy("block_id", "field").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    every = _records(blocks).where(F.col("text").isNotNull()).groupBy("block_id", "field").agg(F.max(F.length("text")).cast("long").alias("chars"))
    out = every.join(spans, ["block_id", "field"], "left").withColumn("shared_chars", F.coalesce("shared", F.lit(0)).cast("long"))
    share = F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0))
    return out.select("block_id", "field", "chars", "shared_chars", share.alias("shared_share"))
