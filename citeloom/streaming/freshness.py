"""Streams of captures and events: windowed counts, and ledgers kept up by merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import evidence
from citeloom.session import shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream with event time. The pattern lets path be a file or a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is there now and give the result; each batch replaces a folder of its own number."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done = {"last": None}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        done["last"] = number

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if done["last"] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{folder}/batch={done['last']}")


def merge_into_ledger(new: DataFrame, folder: str, version: int, key: str, current: DataFrame) -> None:
    """For foreachBatch: the ledger's next version is the last one with the batch merged in.

    Versions are folders, so a batch that runs again writes the same one again.
    """
    spark = new.sparkSession
    merged = new if version == 0 else evidence.ledger_merge(spark.read.parquet(f"{folder}/v{version - 1}"), new, current, key)
    merged.write.mode("overwrite").parquet(f"{folder}/v{version}")
