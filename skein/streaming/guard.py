"""A guard over growing sessions: sizes watched as a stream, tiers, overflow, a circuit breaker.

`watch` follows transcript files line by line as they are appended to. A file's size before and
after a micro-batch says whether it rose to a tier, so no state is kept for that: soft and hard tiers
are pruned, overflowing sessions recovered under a breaker, and the teams of touched sessions
checkpointed if they changed. `start_guard` does the counting for any stream of lines.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import diagnosis, executor, team
from skein.operators.diagnosis import breaker_windows, tier
from skein.session import cut, exists
from skein.sources import jsonl, transcripts
from skein.streaming.recovery import Breaker, overflowed, recover, written

HARD_BYTES = 50 * 1024 * 1024
DANGER_BYTES = 90 * 1024 * 1024
TEAMS = "session_id string, hash string, epoch long"
#: Files of one read, as their paths go through the driver.
FILES_AT_ONCE = 1000


def _rank(name: Column) -> Column:
    return F.when(name == "hard", 2).when(name == "soft", 1).otherwise(0)


def running_sizes(stream: DataFrame) -> DataFrame:
    """Bytes and lines of each session so far, from a stream of (session_id, byte_size)."""
    return stream.groupBy("session_id").agg(F.sum("byte_size").alias("bytes"), F.count(F.lit(1)).alias("lines"))


def growth_events(spark: SparkSession, sizes: DataFrame, state: str, hard: float, soft: float | None, epoch: int) -> DataFrame:
    """Sessions whose tier rose above the highest they had: session_id, bytes, tier, epoch.

    `state` is the folder of events so far; sizes never shrink a session's highest tier, and an
    epoch that is run again gives the same events.
    """
    now = sizes.select("session_id", "bytes", tier(F.col("bytes"), hard, soft).alias("tier")).where("tier <> 'none'")
    schema = "session_id string, bytes long, tier string, epoch long"
    past = spark.read.schema(schema).parquet(state) if exists(spark, state) else spark.createDataFrame([], schema)
    top = past.where(F.col("epoch") < epoch).groupBy("session_id").agg(F.max(_rank(F.col("tier"))).alias("had"))
    rose = now.join(top, "session_id", "left").where(_rank(F.col("tier")) > F.coalesce("had", F.lit(0)))
    return rose.select("session_id", "bytes", "tier", F.lit(epoch).cast("long").alias("epoch"))


def start_guard(
    lines: DataFrame, state: str, checkpoint: str, hard: float = HARD_BYTES, soft: float | None = None,
    on_tier: Callable[[DataFrame, int], None] | None = None, available_now: bool = False, interval: str = "30 seconds", name: str = "skein_guard",
) -> StreamingQuery:
    """Watches a stream of lines (session_id, byte_size) and records each session's rise to a tier.

    One query of a name runs at a time. Events are written per epoch, so a batch that is repeated
    after a failure overwrites its own events only; `on_tier` gets the events of each batch.
    """

    def batch(sizes: DataFrame, epoch: int) -> None:
        events = growth_events(sizes.sparkSession, sizes, state, hard, soft, epoch)
        events.drop("epoch").write.mode("overwrite").parquet(f"{state}/epoch={epoch}")
        if on_tier is not None:
            on_tier(sizes.sparkSession.read.parquet(f"{state}/epoch={epoch}"), epoch)

    writer = running_sizes(lines).writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _sessions(spark: SparkSession, files: DataFrame) -> Iterator[DataFrame]:
    """The message model of the files (path), in blocks of bounded number."""
    block = []
    for row in files.select("path").distinct().toLocalIterator():
        block.append(row.path)
        if len(block) == FILES_AT_ONCE:
            yield jsonl.read_sessions(spark, block)
            block = []
    if block:
        yield jsonl.read_sessions(spark, block)


def _all_sessions(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    out = None
    for lines in _sessions(spark, files):
        out = lines if out is None else out.unionByName(lines)
    return out


def prune_cycle(lines: DataFrame, prescription: str, target: str, version: str, config: dict | None = None, stamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Prunes sessions with their teams spared and writes them as a new version: session_id, bytes_after."""
    run = lambda some: executor.run_prescription(some, prescription, config)[0]
    out = cut(team.team_protected(lines, run, stamp))
    jsonl.write_version(out, target, version)
    return diagnosis.totals(out).select("session_id", F.col("bytes").alias("bytes_after"))


def checkpoint_teams(lines: DataFrame, state: str, epoch: int) -> int:
    """Writes the team reports that changed since the last checkpoint, and remembers them; how many there were."""
    spark = lines.sparkSession
    states = team.team_state(lines).where(~team.is_empty()).withColumn("hash", team.change_hash())
    known = written(spark, f"{state}/teams", TEAMS).where(F.col("epoch") < epoch).groupBy("session_id").agg(F.max_by("hash", "epoch").alias("known"))
    changed = cut(states.join(known, "session_id", "left").where(~F.col("hash").eqNullSafe(F.col("known"))).select("session_id", "hash", team.checkpoint_text().alias("report")))
    changed.select("session_id", "hash", F.lit(epoch).cast("long").alias("epoch")).write.mode("append").json(f"{state}/teams")
    changed.select("session_id", "report").write.mode("overwrite").json(f"{state}/reports/epoch={epoch}")
    return changed.count()


def watch(
    spark: SparkSession, folder: str, state: str, checkpoint: str, hard: float = HARD_BYTES, soft: float | None = None, danger: float = DANGER_BYTES, prescription: str = "standard", most: int = 3, seconds: float = 300,
    available_now: bool = False, interval: str = "30 seconds", clock: Callable[[], float] = time.time, name: str = "skein_watch",
) -> StreamingQuery:
    """Guards the transcripts below a folder: what is appended to them is seen, pruned, recovered and checkpointed.

    Below `state` are written: events (one row for each session that rose to a tier or overflowed:
    session_id, bytes, tier, action, prescription, bytes_after), versions (pruned sessions; the files
    themselves stay), recoveries (the breaker's), teams and reports. Only files that grew are read
    again. A batch that is repeated after a failure overwrites its own events and reports.
    """
    breaker = Breaker(spark, f"{state}/recoveries", most, seconds)

    def tick(batch: DataFrame, epoch: int) -> None:
        grown = cut(batch.groupBy("session_id", "path").agg(F.max("size_before").alias("was"), F.max("size_now").alias("bytes")))
        if grown.isEmpty():
            return
        now = clock()
        stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))

        def prune(some: DataFrame, step: str) -> DataFrame:
            lines = _all_sessions(spark, grown.join(some, "session_id", "left_semi"))
            return prune_cycle(lines, step, f"{state}/versions", f"{epoch}-{step}-{uuid_of(now)}", None, stamp)

        over = cut(overflowed(grown, danger))
        outcomes = recover(over, breaker, now, danger, prune)
        level = tier(F.col("bytes"), hard, soft)
        rose = grown.join(over.select("session_id"), "session_id", "left_anti").where(_rank(level) > _rank(tier(F.col("was"), hard, soft)))
        rose = cut(rose.select("session_id", "path", "bytes", level.alias("tier")))
        none = "session_id string, bytes_after long"
        pruned = spark.createDataFrame([], none) if rose.isEmpty() else cut(prune(rose.select("session_id"), prescription))
        plain = rose.join(pruned, "session_id", "left").select("session_id", "bytes", "tier", F.lit("pruned").alias("action"), F.lit(prescription).alias("prescription"), "bytes_after")
        saved = outcomes.select("session_id", F.col("bytes_before").alias("bytes"), F.lit("overflow").alias("tier"), F.col("outcome").alias("action"), "prescription", "bytes_after")
        plain.unionByName(saved).write.mode("overwrite").json(f"{state}/events/epoch={epoch}")
        for lines in _sessions(spark, grown):
            checkpoint_teams(lines, state, epoch)

    writer = transcripts.stream(spark, folder).writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(tick)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def uuid_of(now: float) -> str:
    """A version's name from the clock, so that a batch repeated later doesn't meet its own older version."""
    return f"{now:.3f}".replace(".", "-")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time, late ones up to a watermark: window_start, event_type, events."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = stamped.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events")


__all__ = ["breaker_windows", "checkpoint_teams", "growth_events", "prune_cycle", "running_sizes", "start_guard", "watch", "windowed_counts"]
