"""Runs of repeated consecutive events, collapsed to one event with count and duration.

Boundary-only rows: within a chunk of bounded size, only the events that differ from their
predecessor are kept, each with its position and with the end of the run before it; a lead over
these starts gives every run its count (difference of positions) and its last event (the end noted
by the next start). Runs that touch a chunk's edge, at most two per chunk, are then joined across
chunks in the same way, so a session may be of any length and no task holds all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.lines import once
from skein.session import CHUNK_LINES


def letters_only(name: Column) -> Column:
    """The name in lower case with everything but letters dropped; null stays null."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}]", ""))


def collapse_runs(lines: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """All maximal runs of consecutive lines with equal `type` and the same `name`.

    Input: session_id, line_index, type, name, ts. Output, one row per run (also those of length
    one): session_id, type, name_key, first_line, last_line, events, first_ts, last_ts,
    duration_us.

    Lines follow each other by line_index within a session; gaps don't matter. A line given twice
    counts once. Names are equal if their letters are, whatever the case; a null type or name
    equals null only (a name without letters is the empty name, not null). Where the first or last
    event of a run has no time, the duration is null. An empty table gives no rows; other columns
    are ignored.
    """
    src = lines.select(
        "session_id", "line_index", "type", letters_only(F.col("name")).alias("name_key"), F.col("ts").alias("ts")
    )
    rows = once(src, ["session_id", "line_index"], ["type", "name_key", "ts"], chunk_lines)
    key = F.struct("type", "name_key")
    w = Window.partitionBy("session_id", "chunk").orderBy("line_index")
    rows = rows.select(
        "session_id", "chunk", "line_index", "type", "name_key", "ts",
        F.row_number().over(w).alias("at"),
        F.lag(key).over(w).alias("before"),
        F.lag("line_index").over(w).alias("end_before"),
        F.lag("ts").over(w).alias("ts_before"),
        F.lead("line_index").over(w).isNull().alias("closes"),
    )
    # a chunk's last event is kept as well: it ends the chunk's last run
    starts = (F.col("at") == 1) | ~F.col("before").eqNullSafe(key)
    kept = rows.withColumn("starts", starts).where(F.col("starts") | F.col("closes"))
    next_starts = F.lead("starts").over(w)
    kept = kept.select(
        "*",
        F.when(next_starts, F.lead("end_before").over(w)).otherwise(F.lead("line_index").over(w)).alias("to_line"),
        F.when(next_starts, F.lead("ts_before").over(w)).otherwise(F.lead("ts").over(w)).alias("to_ts"),
        F.when(next_starts, F.lead("at").over(w)).otherwise(F.lead("at").over(w) + 1).alias("to_at"),
        (F.lead("at").over(w).isNull() | ~next_starts).alias("last_run"),
    )
    alone = F.col("closes")  # a start that is the chunk's last event
    runs = kept.where("starts").select(
        "session_id", "chunk", "type", "name_key",
        F.col("line_index").alias("first_line"), F.col("ts").alias("first_ts"),
        F.when(alone, F.col("line_index")).otherwise(F.col("to_line")).alias("last_line"),
        F.when(alone, F.col("ts")).otherwise(F.col("to_ts")).alias("last_ts"),
        F.when(alone, F.lit(1)).otherwise(F.col("to_at") - F.col("at")).cast("long").alias("events"),
        ((F.col("at") == 1) | alone | F.col("last_run")).alias("edge"),
    )
    inner = runs.where(~F.col("edge")).drop("edge", "chunk")
    s = Window.partitionBy("session_id").orderBy("first_line")
    edges = runs.where("edge").drop("edge")
    # two edge runs join if their keys are equal and no inner run lies between: in one chunk, the
    # first and the last run are neighbours only if the events between them are none
    edges = edges.withColumn("before", F.lag(key).over(s)).withColumn("chunk_before", F.lag("chunk").over(s))
    joins = F.col("before").eqNullSafe(key) & F.col("chunk_before").isNotNull() & (F.col("chunk_before") != F.col("chunk"))
    edges = edges.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(s))
    joined = edges.groupBy("session_id", "island").agg(
        F.first("type").alias("type"), F.first("name_key").alias("name_key"),
        F.min("first_line").alias("first_line"), F.min_by("first_ts", "first_line").alias("first_ts"),
        F.max("last_line").alias("last_line"), F.max_by("last_ts", "first_line").alias("last_ts"),
        F.sum("events").alias("events"),
    )
    out = inner.unionByName(joined.drop("island"))
    micros = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    return out.select("session_id", "type", "name_key", "first_line", "last_line", "events", "first_ts", "last_ts", micros.alias("duration_us"))


def repeated_runs(lines: DataFrame, least: int = 3, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Runs of at least `least` lines: session_id, first_line, last_line."""
    runs = collapse_runs(lines, chunk_lines).where(F.col("events") >= least)
    return runs.select("session_id", "first_line", "last_line")
