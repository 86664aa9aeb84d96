"""Writers that publish whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def publish(frames: dict[str, DataFrame]) -> None:
    """Writes every frame beside its destination, then moves all in; an error puts the old ones back.

    Destinations must differ.  Readers see a destination's old or new state, never a mixture.
    """
    spark = next(iter(frames.values())).sparkSession
    tag, staged, kept, moved = uuid.uuid4().hex, {}, {}, []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        for to, df in frames.items():
            staged[to] = f"{to}.new-{tag}"
            df.write.parquet(staged[to])
        for to in frames:
            fs, target = _fs(spark, to)
            if fs.exists(target):
                kept[to] = f"{to}.old-{tag}"
                if not fs.rename(target, path(kept[to])):
                    raise OSError(f"cannot set aside {to}")
            if not fs.rename(path(staged[to]), target):
                raise OSError(f"cannot move to {to}")
            moved.append(to)
    except Exception:
        for to in moved:
            fs, target = _fs(spark, to)
            fs.delete(target, True)
        for to, old in kept.items():
            fs, target = _fs(spark, to)
            fs.rename(path(old), target)
        for new in staged.values():
            fs, target = _fs(spark, new)
            fs.delete(target, True)
        raise
    for old in kept.values():
        fs, target = _fs(spark, old)
        fs.delete(target, True)


def write_snapshot(df: DataFrame, to: str, version: int, signature: str = "") -> None:
    """An index with its version and source signature on every row."""
    publish({to: df.withColumn("schema_version", F.lit(version)).withColumn("source_signature", F.lit(signature))})


def append_log(df: DataFrame, to: str) -> None:
    df.write.mode("append").json(to)


def write_bundle(blocks: DataFrame, to: str, key: str = "document_id", files: int | None = None) -> None:
    """Documents as JSON lines, a document's rows beside one another in one file; files: how many, by default as many as tasks."""
    spread = blocks.repartitionByRange(files, key) if files else blocks.repartitionByRange(key)
    spread.sortWithinPartitions(key).write.mode("overwrite").json(to)


def commit_batches(stream: DataFrame, to: str, checkpoint: str):
    """A stream whose micro-batches are appended once each: the batch number is in every row."""
    def commit(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit)
