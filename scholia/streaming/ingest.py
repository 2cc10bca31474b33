"""Incremental ingest: deduplicated append, micro-batches, quarantine, date resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what there is in micro-batches, then stop; the checkpoint resumes after a loss."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_unseen(target: str, key: str, order: Column) -> Callable[[DataFrame, int], None]:
    """A batch function that appends rows whose key the target lacks, the first of each key.

    Batches are written to folders of their number, so a batch that is repeated after a failure
    overwrites itself and nothing doubles.
    """
    from scholia.operators.catalog import first_per_key

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_per_key(batch.filter(F.col(key).isNotNull()), key, [order])
        if _exists(spark, target):
            seen = spark.read.option("basePath", target).parquet(target).filter(F.col("batch") != number)
            new = new.join(seen.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def split_bad(target: str, quarantine: str, good: Column) -> Callable[[DataFrame, int], None]:
    """Good rows to the target, the others to a quarantine."""

    def write(batch: DataFrame, number: int) -> None:
        flagged = batch.withColumn("_good", F.coalesce(good, F.lit(False)))
        flagged.filter("_good").drop("_good").write.mode("overwrite").parquet(f"{target}/batch={number}")
        flagged.filter("NOT _good").drop("_good").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return write


def resume_from(rows: DataFrame, done: DataFrame, day: str, key: str) -> DataFrame:
    """Rows from the last finished day on, without those already there (instead of skipping up to an id)."""
    last = done.agg(F.max(day).alias("_last"))  # one row
    recent = rows.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(day) >= F.col("_last"))).drop("_last")
    return recent.join(done.select(key), key, "left_anti").dropDuplicates([key])


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
