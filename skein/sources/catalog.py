"""The session catalogue: one row per transcript file, and finding sessions in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_table(files: DataFrame) -> DataFrame:
    """path, project, session_id, size, mtime, lines; of repeated rows the greatest known values."""
    known = files.where(F.col("path").isNotNull()).groupBy("path")
    return known.agg(*[F.max(c).alias(c) for c in ("project", "session_id", "size", "mtime", "lines")])


def from_files(spark: SparkSession, pattern: str, project: str | None = None) -> DataFrame:
    """The catalogue of the *.jsonl files below a path; physical lines are counted, backups left out (see `backups`).

    `project` keeps projects whose name contains it, whatever the case.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(pattern)
    meta = F.col("_metadata")
    rows = text.groupBy(meta["file_path"].alias("path")).agg(
        F.first(meta["file_size"]).alias("size"), F.first(meta["file_modification_time"]).alias("mtime"), F.count(F.lit(1)).alias("lines")
    )
    parts = F.split("path", "/")
    rows = rows.withColumn("project", F.element_at(parts, -2)).withColumn("session_id", F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))
    if project is not None:
        rows = rows.where(F.contains(F.lower("project"), F.lit(project.lower())))
    return rows.select("path", "project", "session_id", "size", "mtime", "lines")


def backups(spark: SparkSession, folder: str) -> DataFrame:
    """The *.bak files below a folder: path, project, session_id, size, mtime, lines (null); their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bak").load(folder)
    null = lambda t: F.lit(None).cast(t)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("project"), null("string").alias("session_id"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), null("long").alias("lines"))


def find(catalogue: DataFrame, wanted: str, cwd: str | None = None) -> DataFrame:
    """The session meant by a path, an id, the beginning of one, or `current`: the newest of the directory's project, else the newest."""
    if wanted == "current":
        slug = (cwd or "").replace("/", "-")
        near = F.contains("project", F.lit(slug)) if slug else F.lit(False)
        return catalogue.where(F.col("mtime").isNotNull()).orderBy(~F.coalesce(near, F.lit(False)), F.desc("mtime"), "path").limit(1)
    if wanted.endswith(".jsonl"):
        return catalogue.where(F.col("path").endswith(wanted)).orderBy(F.length("path"), "path").limit(1)
    return resolve(catalogue, wanted)


def usual_project(catalogue: DataFrame) -> DataFrame:
    """The project that most sessions are of: project (the mode; the first by name of several)."""
    return catalogue.groupBy("project").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "project").limit(1).select("project")


def resolve(catalogue: DataFrame, wanted: str) -> DataFrame:
    """The session with that id, or the first in (project, path) order whose id begins with it; at most one row."""
    hits = catalogue.where(F.col("session_id").startswith(wanted))
    return hits.orderBy(F.col("session_id") != wanted, "project", "path").limit(1)


def newest(catalogue: DataFrame, project: str | None = None) -> DataFrame:
    """The session changed last, of a project whose name contains `project` if given; at most one row."""
    rows = catalogue if project is None else catalogue.where(F.contains("project", F.lit(project)))
    return rows.where(F.col("mtime").isNotNull()).orderBy(F.desc("mtime"), "path").limit(1)


def tail(lines: DataFrame, count: int) -> DataFrame:
    """The last `count` lines of each session: chunk by chunk first, then of what is left."""
    from pyspark.sql import Window

    from skein.operators.lines import CHUNK_KEY

    back = F.col("line_index").desc()
    near = lines.withColumn("_r", F.row_number().over(Window.partitionBy(*CHUNK_KEY).orderBy(back))).where(F.col("_r") <= count)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(back))).where(F.col("_r") <= count).drop("_r")


def tail_contains(lines: DataFrame, text: str, count: int = 50, column: str = "raw") -> DataFrame:
    """Whether any of a session's last `count` lines contains the text: session_id, found."""
    return tail(lines, count).groupBy("session_id").agg(F.max(F.coalesce(F.contains(column, F.lit(text)), F.lit(False))).alias("found"))


def match_by_text(catalogue: DataFrame, lines: DataFrame, text: str, count: int = 50, column: str = "raw") -> DataFrame:
    """The newest session whose last lines contain the text; at most one row of the catalogue."""
    hits = tail_contains(lines, text, count, column).where("found").select("session_id")
    return newest(catalogue.join(hits, "session_id", "left_semi"))
