"""Keyed state kept current from a stream of changes.

Each micro-batch is reduced to the newest change per key and merged into the last snapshot; the result is a new
snapshot folder named after the batch, so that a batch that is replayed after a failure writes the same folder again
and state is never overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def apply_changes(state: DataFrame | None, changes: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The state after the changes: per key the newest of both.

    A key whose newest row is marked in the column `deleted` stays as a tombstone, so that an older change that comes late does not
    bring it back; `live` leaves tombstones out.
    """
    both = changes if state is None else state.unionByName(changes, allowMissingColumns=True)
    out = newest_changes(both, keys, order)
    return out if deleted is None else out.withColumn(deleted, F.coalesce(F.col(deleted), F.lit(False)))


def live(state: DataFrame, deleted: str) -> DataFrame:
    """The state without the keys whose newest row is marked deleted."""
    return state.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def snapshot_path(root: str, batch: int) -> str:
    return f"{root.rstrip('/')}/batch={batch:012d}"


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The state of the last complete batch, or None before the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None


def maintain(changes: DataFrame, root: str, checkpoint: str, keys: list[str], order: list[str], deleted: str | None = None) -> StreamingQuery:
    """Runs over what the stream has and stops; start it again for what comes later."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = _before(spark, root, number)
        apply_changes(before, df, keys, order, deleted).write.mode("overwrite").parquet(snapshot_path(root, number))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark: SparkSession, root: str, number: int) -> DataFrame | None:
    return None if number == 0 else spark.read.parquet(snapshot_path(root, number - 1))


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str, late: str) -> DataFrame:
    """Counts per window and group with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
