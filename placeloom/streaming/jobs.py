"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..plans.graph import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incremental(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Run handle once per new batch, commit after it; a batch repeated after a failure has the same id."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand_by_week(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("demand")).select(F.col("w.start").alias("week"), "event_type", "demand")


def usage_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("day"), "user_id", "requests", "errors")


def distinct_interactions(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def reformulated(traces: DataFrame, events: DataFrame, seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """trace_id, event_id: a reformulation of the trace's query (from_query = query) within `seconds` after it."""
    t = traces.withWatermark("trace_ts", late)
    e = events.withWatermark("event_ts", late)
    near = F.expr(f"from_query = query AND event_ts >= trace_ts AND event_ts <= trace_ts + INTERVAL {seconds} SECONDS")
    return t.join(e, near).select("trace_id", "event_id")


class Ema(StatefulProcessor):
    """Exponential moving average of each key's values, kept as value state."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", StructType([StructField("ema", DoubleType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        ema, n = (now[0], now[1]) if now else (None, 0)
        for pdf in rows:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                ema = float(v) if ema is None else (1 - self.alpha) * ema + self.alpha * float(v)
                n += 1
        self.state.update((ema, n))
        yield pd.DataFrame({"key": [key[0]], "ema": [ema], "n": [n]})

    def close(self) -> None:
        pass


def ema_by_key(events: DataFrame, key: str, alpha: float) -> DataFrame:
    """Needs spark.sql.streaming.stateStore.providerClass = the RocksDB provider."""
    return events.groupBy(key).transformWithStateInPandas(Ema(alpha), f"key {events.schema[key].dataType.simpleString()}, ema double, n long", "Update", "none")


class Health(StatefulProcessor):
    """The last `most` calls of a key that are not older than `seconds`, as list state; trips below `least` successes of `enough` calls."""

    def __init__(self, most: int, seconds: int, least: float, enough: int):
        self.most, self.seconds, self.least, self.enough = most, seconds, least, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getListState("calls", StructType([StructField("t", DoubleType()), StructField("id", LongType()), StructField("ok", BooleanType()), StructField("ms", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = list(self.calls.get()) if self.calls.exists() else []
        for pdf in rows:
            calls += zip(pdf["t"].astype(float), pdf["event_id"].astype(int), pdf["ok"].astype(bool), pdf["ms"].astype(float))
            calls = sorted(tuple(c) for c in calls)[-self.most :]
        calls = [(float(t), int(i), bool(ok), float(ms)) for t, i, ok, ms in calls if t >= calls[-1][0] - self.seconds]
        self.calls.put(calls)
        rate = sum(c[2] for c in calls) / len(calls)
        ms = sorted(c[3] for c in calls)
        yield pd.DataFrame({"key": [key[0]], "n": [len(calls)], "success_rate": [rate], "p95": [ms[-(-len(ms) * 95 // 100) - 1]], "tripped": [len(calls) >= self.enough and rate < self.least]})

    def close(self) -> None:
        pass


def health_by_key(calls: DataFrame, key: str, most: int = 64, seconds: int = 1800, least: float = 0.5, enough: int = 8) -> DataFrame:
    """key, n, success_rate, p95, tripped after each batch of calls(t in seconds, event_id, ok, ms). Needs the RocksDB provider."""
    return calls.groupBy(key).transformWithStateInPandas(Health(most, seconds, least, enough), f"key {calls.schema[key].dataType.simpleString()}, n long, success_rate double, p95 double, tripped boolean", "Update", "none")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Everything that the stream gives now, as a table with batch_id; a batch that is repeated replaces its own part."""
    path = shared_path(spark, name)
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch_id={i}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch_id", LongType()) if "batch_id" not in stream.columns else stream.schema).parquet(path)


def latest(table: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of its last batch."""
    rest = [c for c in table.columns if c not in (*keys, "batch_id")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r")).select(*keys, "__r.*")
