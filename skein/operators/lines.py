"""Helpers on ordered lines: one row per line, chunks of bounded size, neighbours across chunks.

Ordered operators never take a whole session into one task. Lines are cut into chunks by line
number; what a row needs from earlier or later rows is first looked for in its own chunk, then in a
carry: one summary row per chunk, in order. Only summaries, one row for thousands of lines, are ever
brought together by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import CHUNK_LINES

CHUNK_KEY = ["session_id", "chunk"]


def chunk_of(order: Column, size: int = CHUNK_LINES) -> Column:
    """Number of the chunk a line lies in; lines of a session are cut every `size` line numbers."""
    return F.floor(order / F.lit(size)).cast("long")


def once(df: DataFrame, keys: list[str], columns: list[str], size: int = CHUNK_LINES) -> DataFrame:
    """One row per line key (`session_id`, `line_index`), already partitioned by session and chunk.

    A line delivered again counts once. The rows are shuffled once, by (session_id, chunk): a hot
    session spreads over its chunks, and the windows that follow over (session_id, chunk) need no
    further exchange. Lines without a session or number have no place in any session and are
    left out. Among copies that differ, the greatest struct of `columns` is taken, so the result
    does not depend on the order of delivery.
    """
    rest = [c for c in columns if c not in keys]
    part = df.where(F.col("session_id").isNotNull() & F.col("line_index").isNotNull())
    part = part.select(*keys, chunk_of(F.col("line_index"), size).alias("chunk"), *rest)
    part = part.repartition("session_id", "chunk")
    if not rest:
        return part.dropDuplicates(["session_id", "chunk", "line_index"])
    one = part.groupBy("session_id", "chunk", "line_index").agg(F.max(F.struct(*rest)).alias("_r"))
    return one.select("session_id", "chunk", "line_index", *[F.col(f"_r.{c}").alias(c) for c in rest])


def nearest(df: DataFrame, values: dict[str, Column], order: list[str], after: bool = False) -> DataFrame:
    """Adds for each name the last non-null value before the row, or the first one after it.

    A value that may be null itself is wrapped in a struct to mean the neighbouring row: that is
    lag and lead. `df` has session_id, chunk and the columns of `order`, which order a session and
    whose order agrees with `chunk`.
    """
    flow = (lambda c: F.col(c).desc()) if after else F.col
    inside = Window.partitionBy(*CHUNK_KEY).orderBy(*[flow(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*order)
    pick = F.min_by if after else F.max_by
    ends = df.groupBy(*CHUNK_KEY).agg(*[pick(v, F.when(v.isNotNull(), key)).alias(n) for n, v in values.items()])
    chunks = Window.partitionBy("session_id").orderBy(flow("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*CHUNK_KEY, *[F.last(n, ignorenulls=True).over(chunks).alias(f"_{n}") for n in values])
    out = df.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(n) for n, v in values.items()]).join(carry, CHUNK_KEY, "left")
    kept = [c for c in df.columns if c not in values]
    return out.select(*kept, *[F.coalesce(F.col(n), F.col(f"_{n}")).alias(n) for n in values])


def positioned(df: DataFrame) -> DataFrame:
    """Adds `pos`, the row's place in its session from 0; gaps in line_index don't count."""
    inside = Window.partitionBy(*CHUNK_KEY).orderBy("line_index")
    chunks = Window.partitionBy("session_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*CHUNK_KEY).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*CHUNK_KEY, F.coalesce(F.sum("_n").over(chunks), F.lit(0)).alias("_before"))
    out = df.withColumn("_at", F.row_number().over(inside)).join(sizes, CHUNK_KEY)
    return out.withColumn("pos", (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_at", "_before")


def numbered(df: DataFrame, keys: list[str], part: Column, order: list[str], name: str = "no") -> DataFrame:
    """Adds `name`, the row's place from 0 among those of its keys, ordered by `part` (its chunk, not null) and then by `order`.

    Rows are numbered within their part; what earlier parts have is added. The order of parts must
    agree with that of the rows.
    """
    rows = df.withColumn("_part", part)
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_at", F.row_number().over(within)).join(sizes, [*keys, "_part"])
    return out.withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_part", "_at", "_before")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once: filters on it stay above, where it has its value."""
    return df.select("*", F.explode(F.array(value)).alias(name))
