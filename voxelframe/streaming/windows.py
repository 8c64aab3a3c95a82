"""Extension: the batch operators' streaming forms over events and detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and type; with ``late``, a watermark so that state is bounded."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_detections(stream: DataFrame, path: str, checkpoint: str):
    """Detections appended chunk by chunk, exactly once; resumes after the last whole chunk."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_total(stream: DataFrame) -> DataFrame:
    """Running number of detections of each sample."""
    return stream.groupBy("sample_id").agg(F.count("*").alias("n"))


def follow_stream(stream: DataFrame, limit: float = 3.0) -> DataFrame:
    """Running translation of each tile in arrival order: a jump over ``limit`` keeps the value before."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for f in frames:
            out = []
            for v in f.sort_values("z").value:
                if last is None or abs(v - last) <= limit:
                    last = float(v)
                out.append(last)
            yield f.sort_values("z")[["tile", "z"]].assign(followed=out)
        if last is not None:
            state.update((last,))

    return stream.groupBy("tile").applyInPandasWithState(run, "tile string, z int, followed double", "last double", "append", GroupStateTimeout.NoTimeout)
