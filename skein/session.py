"""Session helpers shared by every operator: reading tables, cutting lineage, sizing chunks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Lines of a session that one task may hold at once. Sessions longer than this are cut into
#: chunks by line number, so no task ever receives a whole unbounded session.
CHUNK_LINES = 4096

#: Rows and bytes of one Arrow batch sent to a Python worker; texts may be long.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of the folder, as a scan that Catalyst can prune and push filters into."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; everything else stays as the session has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and go on from the files.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset
    (tests on one machine) a folder of our own is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark would read it from."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name in the one the cluster names in spark.checkpoint.dir; an own one only where it is unset and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{name}" if root else tempfile.mkdtemp(prefix=f"{name}-")
