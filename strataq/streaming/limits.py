"""Streaming twins of the order-dependent folds: state per key, kept small, with a timeout on the event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq import settings as S


def rate_limit(requests: DataFrame, key: str, ts: str, rid: str, limit: int = S.DEFAULT.limits.per_window, window_s: int = S.DEFAULT.limits.window_s, delay: str = "10 minutes") -> DataFrame:
    """(rid, key, admitted) for a stream of requests; state of a key: its admitted times within the window.

    Requests of one batch are taken in order of time and id; a request older than the newest seen is judged by the
    times still in state. Equals the batch fold where requests arrive in order.
    """
    src = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(rid).alias("rid"), F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "rid"])
        out = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            kept = [x for x in kept if t - x <= window_s * 1_000_000]
            ok = len(kept) < limit
            if ok:
                kept.append(int(t))
            out.append(ok)
        state.update((kept,))
        after = max((kept[-1] if kept else 0) // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(int(after))
        yield pd.DataFrame({"rid": rows["rid"].to_numpy(), "key": k[0], "admitted": out})

    id_type = requests.schema[rid].dataType.simpleString()
    return src.groupBy("key").applyInPandasWithState(step, f"rid {id_type}, key string, admitted boolean", "times array<bigint>", "append", "EventTimeTimeout")


def requests_per_window(requests: DataFrame, key: str, ts: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Late-tolerant counts of requests per key and tumbling window."""
    src = requests.where(F.col(key).isNotNull()).withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    return src.groupBy(F.col(key).alias("key"), F.window("_t", window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), "n")
