"""The task and event feed as a stream. The batch forms of the same queries are in ``plans.feeds``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veinstone.session import shared_dir


def read_feed(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def rate_windows(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events of each user and type in fixed windows; a watermark lets finished windows go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), "user_id", "event_type", "n")


def stale_tasks(events: DataFrame, key: str = "user_id", hours: int = 12) -> DataFrame:
    """(key, last, state): tasks whose last event is older than ``hours`` before the watermark; state is one time a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last": [pd.Timestamp(last, unit="ms")], "state": ["stale"]})
            return
        newest = max(int(b["ts"].max().timestamp() * 1000) for b in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(newest + hours * 3_600_000)

    return events.withWatermark("ts", "1 minute").groupBy(key).applyInPandasWithState(step, "key long, last timestamp, state string", "newest long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into a table of the shared folder, and that table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/veinstone/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # The number names the folder, so that a batch that is run again replaces itself.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")
