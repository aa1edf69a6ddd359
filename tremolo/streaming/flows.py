"""Streaming forms: tumbling means and the sequential test with state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_means(stream: DataFrame, width: str = "1 hour", late: str = "1 hour", time: str = "ts", by: str = "rec", x: str = "x") -> DataFrame:
    """(by, start, mean, n) of each window, once the watermark has passed it."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n")).select(by, F.col("window.start").alias("start"), "mean", "n")


def stateful_sprt(stream: DataFrame, alpha: float = 0.1, beta: float = 0.1, time: str = "ts", late: str = "1 hour", by: str = "rec") -> DataFrame:
    """(by, event_id, label): the test's running sum lives in the state of its recording.

    Rows of a batch are taken in the order of time and id; rows later than the watermark are dropped.
    """
    low, high = math.log(beta / (1 - alpha)), math.log((1 - beta) / alpha)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values([time, "event_id"], kind="stable")
        labels = []
        for p in rows["p"]:
            odds = math.log(p) - math.log(1 - p)
            total += odds
            label = 1 if total > high else -1 if total < low else 0
            labels.append(label)
            total = odds if label else total
        state.update((total,))
        yield pd.DataFrame({by: key[0], "event_id": rows["event_id"].to_numpy(), "label": labels})

    return stream.withWatermark(time, late).groupBy(by).applyInPandasWithState(step, f"{by} bigint, event_id bigint, label bigint", "total double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is available now, written to path and read back."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
