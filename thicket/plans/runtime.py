"""Session, lineage and join helpers used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the count is taken before the join.
BROADCAST_ROWS = 200_000


def local_session(cores: str = "8", partitions: int = 8, app: str = "thicket") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage.

    The folder is the one named by ``spark.checkpoint.dir``. Only in a single JVM (tests, a
    laptop) a temporary one, removed at exit, is made where that is unset; on a cluster
    executors share no local folder, so there it must be set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="thicket-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new file in the checkpoint folder, which all executors share."""
    cut(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str, *order: str | Column, start: int = 1, small: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in a total order.

    Beyond ``small`` rows (counted) no task sees them all: rows are sorted by ranges, and every
    range adds the number of rows in those before it.
    """
    if df.limit(small + 1).count() <= small:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy().orderBy(*order)) + (start - 1)).cast("int"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n"))  # one row a partition
    at = F.col("_at") - F.col("_first") + F.col("_before") + start
    return placed.join(F.broadcast(before.select("_part", "_first", "_before")), "_part").withColumn(name, at.cast("int")).drop("_part", "_at", "_first", "_before")


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows.

    Beyond the bound the frame is returned unchanged, so Catalyst and AQE choose a
    shuffled join (with skew splitting).
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
