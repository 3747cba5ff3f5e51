"""Structured Streaming forms of the operators: windows with watermarks, deduplication, and the ordered state machines."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from opsloom.operators.stateful import Accumulator, Debounce, Step


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder; a bound on files a trigger is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def metric_windows(metrics: DataFrame, width: str, late: str, at: str = "ts") -> DataFrame:
    """Tumbling windows of outcomes; rows later than the watermark are dropped, as expired ones are."""
    return (
        metrics.withWatermark(at, late)
        .groupBy(F.window(at, width), "task_name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("succeeded").alias("success"))
        .select(F.col("window.start").alias("start"), "task_name", "n", "success")
    )


def unique_within(df: DataFrame, key: str, at: str, late: str) -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def debounced_sessions(df: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Bursts by gap alone, without the cap on waiting."""
    session = F.session_window(at, gap)
    return df.withWatermark(at, late).groupBy(session, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("fires_at"), "n")


def stateful(df: DataFrame, key: str, order: list[str], step: Step, fields: list[str], out_schema: str, state_schema: str) -> DataFrame:
    """A step function over a stream; its state, whose `fields` are columns of the state store, survives restarts."""
    columns = [part.split()[0] for part in out_schema.split(",")]

    def run(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(fields, state.get, strict=True)) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for row in rows.to_dict("records"):
            held, found = step(held, row)
            out += found
        if held is None:
            state.remove()
        else:
            state.update(tuple(held[f] for f in fields))
        yield pd.DataFrame(out, columns=columns)

    return df.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", "NoTimeout")


class Timed(StatefulProcessor):
    """A step function whose state ends at a deadline: rows go through it in order, and a timer at the deadline makes its last
    outputs, so that a burst ends when the watermark passes its time, whether or not its key has another row."""

    def __init__(self, step, fields: list[str], state_schema: str, deadline: Callable[[dict], int], columns: list[str], order: list[str]):
        self.step, self.fields, self.state_schema, self.deadline, self.columns, self.order = step, fields, state_schema, deadline, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.state_schema)

    def keep(self, state: dict | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.held.clear()
        else:
            self.held.update(tuple(state[f] for f in self.fields))
            self.handle.registerTimer(self.deadline(state))

    def state(self) -> dict | None:
        return dict(zip(self.fields, self.held.get(), strict=True)) if self.held.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.state(), []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            state, found = self.step(state, row)
            out += found
        self.keep(state)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state()
        out = self.step.finish(state) if state else []
        self.keep(None)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


#: State with timers is kept in this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(df: DataFrame, step, fields: list[str], state_schema: str, deadline: Callable[[dict], int], out_schema: str, late: str) -> DataFrame:
    """A step function with a deadline over a stream of key, seq and at_ms. Rows later than the watermark are dropped."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = [part.split()[0] for part in out_schema.split(",")]
    processor = Timed(step, fields, state_schema, deadline, columns, ["at_ms", "seq"])
    rows = df.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", late)
    return rows.groupBy("key").transformWithStateInPandas(processor, StructType.fromDDL(out_schema), "append", "EventTime")


def debounce_stream(df: DataFrame, step: Debounce, late: str) -> DataFrame:
    state = "key string, first bigint, deadline bigint, n bigint, last_seq bigint"
    return timed(df, step, ["key", "first", "deadline", "n", "last_seq"], state, lambda s: s["deadline"], "key string, first_seen bigint, fires_at bigint, n bigint, last_seq bigint", late)


def accumulate_stream(df: DataFrame, step: Accumulator, late: str) -> DataFrame:
    wait = step.max_wait_ms
    return timed(df, step, ["key", "first", "n", "first_seq"], "key string, first bigint, n bigint, first_seq bigint", lambda s: s["first"] + wait, "key string, first_seq bigint, n bigint, flushed_at bigint", late)


def token_bucket_stream(df: DataFrame, step: Step) -> DataFrame:
    return stateful(df, "key", ["at_ms", "seq"], step, ["tokens", "at"], "seq bigint, key string, allowed boolean", "tokens double, at bigint")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Processes what is there into Parquet files and stops; a later run goes on from the checkpoint."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def idempotent_sink(write):
    """A foreachBatch function for a sink that is told the batch id, so that a batch that is tried again changes nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch.withColumn("batch_id", F.lit(batch_id)), batch_id)

    return each
