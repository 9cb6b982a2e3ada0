"""Structured Streaming over the telemetry table."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; event time becomes a timestamp so that watermarks apply."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = "2 days") -> DataFrame:
    """start, event_type, n, max_value of tumbling or sliding windows; state older than the watermark is dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select(F.col("window.start").alias("start"), "event_type", "n", "max_value")


def changes(stream: DataFrame) -> DataFrame:
    """object_id, event_id, stamp of the rows whose stamp differs from the object's last one, which is all the state."""

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        for b in [pd.concat(list(batches)).sort_values(["ts", "event_id"])]:
            before = b["event_type"].shift(1)
            before.iloc[0] = last
            out = b[b["event_type"] != before]
            state.update((b["event_type"].iloc[-1],))
            yield pd.DataFrame({"object_id": key[0], "event_id": out["event_id"], "stamp": out["event_type"]})

    rows = stream.select(F.col("user_id").alias("object_id"), "event_id", "ts", "event_type")
    return rows.groupBy("object_id").applyInPandasWithState(step, "object_id long, event_id long, stamp string", "stamp string", "append", "NoTimeout")


def drained(result: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now; its batches are written as Parquet in the shared folder and read back.

    In update mode the last version of each key counts. No result and no state passes through the driver.
    """
    spark = result.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/n={number}")

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    names = [c for c in result.columns if c not in (keys or ())]
    rows = spark.read.option("recursiveFileLookup", "true").schema(", ".join(f"{n} {t}" for n, t in result.dtypes) + ", __batch int").parquet(f"{at}/rows")
    if keys is None:
        return rows.drop("__batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "__batch").alias("r")).select(*keys, "r.*")
