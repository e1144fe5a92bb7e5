"""Recovery of sessions that overflow: a gate, a breaker with kept state, and the prune itself.

Recoveries are rows of an append-only table, so a breaker outlives its process, and several sessions
are recovered at once. A session may be recovered `most` times within a rolling window; each time
the prescription is the next one up. Expired rows count no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.session import cut, exists
from skein.sources.transcripts import opened

OVERFLOW_MARK = "Conversation too long"
LADDER = ("gentle", "standard", "aggressive")
RECOVERIES = "key string, at double, prescription string, bytes_before long, bytes_after long"
#: Bytes at a file's end, and lines in them, in which the mark is looked for.
TAIL_BYTES, TAIL_LINES = 100 * 1024, 20
#: Above this share of the danger threshold a pruned session isn't resumed.
RESUME_SHARE = 0.95


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a table of JSON files that may not exist yet; what can't be read is left out."""
    if not exists(spark, folder):
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


class Breaker:
    """How often each session was recovered of late, in a table at `folder`."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 3, seconds: float = 300):
        self.spark, self.folder, self.most, self.seconds = spark, folder, most, seconds

    def state(self, keys: DataFrame, now: float) -> DataFrame:
        """For each `key`: recent, allowed, prescription (null if not allowed). A reset (prescription `reset`) clears what was before."""
        rows = written(self.spark, self.folder, RECOVERIES).where((F.col("at") > now - self.seconds) & (F.col("at") <= now))
        cleared = rows.where("prescription = 'reset'").groupBy("key").agg(F.max("at").alias("cleared"))
        rows = rows.where("prescription <> 'reset'").join(cleared, "key", "left").where("cleared is null or at > cleared")
        recent = keys.select("key").distinct().join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("recent")), "key", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
        step = F.element_at(F.array(*[F.lit(x) for x in LADDER]), F.least(F.col("recent") + 1, F.lit(len(LADDER))).cast("int"))
        return recent.select("key", "recent", (F.col("recent") < self.most).alias("allowed"), F.when(F.col("recent") < self.most, step).alias("prescription"))

    def record(self, recoveries: DataFrame) -> None:
        """Adds rows of key, at, prescription, bytes_before, bytes_after."""
        recoveries.select("key", F.col("at").cast("double").alias("at"), "prescription", F.col("bytes_before").cast("long").alias("bytes_before"), F.col("bytes_after").cast("long").alias("bytes_after")).write.mode("append").json(self.folder)

    def reset(self, keys: DataFrame, now: float) -> None:
        self.record(keys.select("key", F.lit(now).alias("at"), F.lit("reset").alias("prescription"), F.lit(0).alias("bytes_before"), F.lit(0).alias("bytes_after")))


def _tails(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for session, path in zip(pdf["session_id"], pdf["path"]):
            system, place = opened(path)
            with system.open_input_file(place) as file:
                size = file.size()
                text = file.read_at(min(TAIL_BYTES, size), max(0, size - TAIL_BYTES)).decode("utf-8", "replace")
            rows += [(session, line) for line in text.strip().split("\n")[-TAIL_LINES:]]
        yield pd.DataFrame(rows, columns=["session_id", "raw"])


def overflowed(files: DataFrame, bytes_: float, mark: str = OVERFLOW_MARK) -> DataFrame:
    """Of files (session_id, path, bytes) those above the danger threshold whose last lines hold the mark: session_id, path, bytes.

    Only the ends of files above the threshold are read.
    """
    near = files.where(F.col("bytes") >= bytes_)
    marked = near.select("session_id", "path").mapInPandas(_tails, "session_id string, raw string").where(F.contains("raw", F.lit(mark))).select("session_id").distinct()
    return near.join(marked, "session_id", "left_semi")


def recover(
    sessions: DataFrame, breaker: Breaker, now: float, danger_bytes: float, prune: Callable[[DataFrame, str], DataFrame], report: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Recovers sessions (session_id, path, bytes): session_id, outcome, prescription, recent, bytes_before, bytes_after.

    Outcomes: `halted` (its breaker is open: only `report` is called), `recovered`, or `too large`
    (pruned, but still near the threshold, so it isn't to be resumed). `prune` gets the sessions of
    one prescription and gives session_id and bytes_after; it is called once for each step of the
    ladder that is needed, for all its sessions together.
    """
    sessions = cut(sessions.select("session_id", F.col("bytes").alias("bytes_before")))
    state = breaker.state(sessions.select(F.col("session_id").alias("key")), now).withColumnRenamed("key", "session_id")
    planned = cut(sessions.join(state, "session_id"))
    halted = planned.where(~F.col("allowed"))
    if report is not None and not halted.isEmpty():
        report(halted.select("session_id"))
    out = halted.select("session_id", F.lit("halted").alias("outcome"), "prescription", "recent", "bytes_before", F.col("bytes_before").alias("bytes_after"))
    for step in [x for x in LADDER if not planned.where(F.col("prescription") == x).isEmpty()]:
        mine = planned.where(F.col("prescription") == step)
        after = cut(prune(mine.select("session_id"), step).select("session_id", F.col("bytes_after").cast("long").alias("bytes_after")))
        done = mine.join(after, "session_id")
        breaker.record(done.select(F.col("session_id").alias("key"), F.lit(now).alias("at"), "prescription", "bytes_before", "bytes_after"))
        outcome = F.when(F.col("bytes_after") > danger_bytes * RESUME_SHARE, "too large").otherwise("recovered")
        out = out.unionByName(done.select("session_id", outcome.alias("outcome"), "prescription", (F.col("recent") + 1).alias("recent"), "bytes_before", "bytes_after"))
    return cut(out)
