"""Read-only diagnostics of sessions: totals, types, block bytes, largest lines, health of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalar import json_size, text_of, truthy
from skein.operators import tokens
from skein.operators.lines import CHUNK_KEY
from skein.operators.strategies import REMINDER

MB = 1024 * 1024


def totals(lines: DataFrame) -> DataFrame:
    """session_id, messages, bytes."""
    return lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("byte_size").cast("long").alias("bytes"))


def type_stats(lines: DataFrame) -> DataFrame:
    """session_id, type, messages, bytes."""
    return lines.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("messages"), F.sum("byte_size").cast("long").alias("bytes"))


def ranked_types(stats: DataFrame) -> DataFrame:
    """The types of each session, those with most bytes first: session_id, rank, type, messages, bytes; ties by name."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("bytes"), "type"))
    return stats.select("session_id", rank.alias("rank"), "type", "messages", "bytes")


def largest(lines: DataFrame, top: int = 10) -> DataFrame:
    """The largest lines of each session: session_id, rank, line_index, type, byte_size.

    Ties go to the later line. Ranked in chunks first, so only `top` rows of each chunk meet.
    """
    order = [F.col("byte_size").desc(), F.col("line_index").desc()]
    rows = lines.select("session_id", "chunk", "line_index", "type", "byte_size")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(*order))).where(F.col("r") <= top)
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    return rows.select("session_id", rank.alias("rank"), "line_index", "type", "byte_size").where(F.col("rank") <= top)


def block_stats(lines: DataFrame) -> DataFrame:
    """session_id, thinking_bytes, signature_bytes, tool_result_bytes, progress, snapshots, reminders."""
    total = lambda f: F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.coalesce(f(b), F.lit(0)))
    of = lambda kind, size: lambda b: F.when(truthy(b["type"] == kind), size(b)).otherwise(0).cast("long")
    spaced = lambda b: F.octet_length(F.to_json(b["content_list"]))
    result = lambda b: F.coalesce(F.octet_length(b["content_str"]), spaced(b))
    return lines.groupBy("session_id").agg(
        F.sum(total(of("thinking", lambda b: json_size(F.coalesce(b["thinking"], F.lit("")))))).alias("thinking_bytes"),
        F.sum(total(of("thinking", lambda b: F.octet_length(b["signature"])))).alias("signature_bytes"),
        F.sum(total(of("tool_result", result))).alias("tool_result_bytes"),
        F.count_if(F.col("type") == "progress").alias("progress"), F.count_if(F.col("type") == "file-history-snapshot").alias("snapshots"),
        F.sum(total(lambda b: F.regexp_count(text_of(b), F.lit(REMINDER)).cast("long"))).alias("reminders"),
    )


def diagnose(lines: DataFrame) -> DataFrame:
    """One row a session with totals, block bytes, the ten largest lines and the token estimate."""
    top = largest(lines).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line_index", "type", "byte_size"))).alias("largest"))
    types = type_stats(lines).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("type", "messages", "bytes"))).alias("types"))
    parts = (block_stats(lines), types, top, tokens.estimate(lines))
    out = totals(lines)
    for part in parts:
        out = out.join(part, "session_id", "left")
    return out


def health(catalogue: DataFrame, session_mb: int = 50, total_mb: tuple[int, int] = (500, 2048), backup_mb: int = 100) -> DataFrame:
    """Checks of the session store: name, status, bytes, sessions.

    `catalogue` has path and size, one row per file; backups are files that end in .bak.
    """
    backup = F.col("path").endswith(".bak")
    size = F.coalesce("size", F.lit(0))
    sums = catalogue.where(F.col("path").isNotNull()).agg(
        F.count_if(~backup & (size > session_mb * MB)).alias("large"), F.coalesce(F.sum(F.when(~backup & (size > session_mb * MB), size)), F.lit(0)).alias("large_bytes"),
        F.coalesce(F.sum(F.when(~backup, size)), F.lit(0)).alias("all_bytes"), F.count_if(~backup).alias("all"),
        F.coalesce(F.sum(F.when(backup, size)), F.lit(0)).alias("backup_bytes"), F.count_if(backup).alias("backups"),
    )
    check = lambda name, status, bytes_, n: F.struct(F.lit(name).alias("name"), status.alias("status"), F.col(bytes_).cast("long").alias("bytes"), F.col(n).cast("long").alias("sessions"))
    whole = F.when(F.col("all_bytes") < total_mb[0] * MB, "ok").when(F.col("all_bytes") < total_mb[1] * MB, "warning").otherwise("issue")
    rows = F.array(
        check("large-sessions", F.when(F.col("large") > 0, "warning").otherwise("ok"), "large_bytes", "large"),
        check("backups", F.when(F.col("backup_bytes") > backup_mb * MB, "warning").otherwise("ok"), "backup_bytes", "backups"),
        check("disk-usage", whole, "all_bytes", "all"),
    )
    return sums.select(F.inline(rows))


def oversized(catalogue: DataFrame, session_mb: int = 50, top: int = 5) -> DataFrame:
    """The largest sessions above the limit: path, size."""
    return catalogue.where(F.col("size") > session_mb * MB).orderBy(F.desc("size"), "path").limit(top).select("path", "size")


def tier(size: Column, hard: float, soft: float | None = None) -> Column:
    """What a session of that size calls for: hard, soft (60 % of hard unless given) or none."""
    soft = hard * 0.6 if soft is None else soft
    return F.when(size >= hard, "hard").when(size >= soft, "soft").otherwise("none")


def breaker_windows(events: DataFrame, seconds: int = 300, most: int = 3) -> DataFrame:
    """For each event the events of its key in the trailing window: key, at, event_id, recent, allowed, prescription.

    `at` are epoch seconds. The prescription steps up with the events before it, up to the third;
    at `most` earlier ones the breaker is open.
    """
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0)
    out = events.select("key", "at", "event_id", F.count(F.lit(1)).over(w).alias("recent"))
    ladder = F.element_at(F.array(F.lit("gentle"), F.lit("standard"), F.lit("aggressive")), F.least(F.col("recent"), F.lit(3)).cast("int"))
    return out.select("key", "at", "event_id", "recent", (F.col("recent") <= most).alias("allowed"), ladder.alias("prescription"))
