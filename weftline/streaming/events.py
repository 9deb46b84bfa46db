"""Streams over events, and a way to run a stream over what is there and get a table back."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.sources import read_table
from weftline.sources.folders import shared_folder


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The events as a stream, with a watermark on their time (as a timestamp with zone, which it needs)."""
    schema = read_table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}/")
    if f"{sf_dir}".endswith(".parquet"):
        raw = spark.readStream.schema(schema).parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def event_batches(spark: SparkSession, parts: list[DataFrame], delay: str = "1 hour", files: int = 4) -> DataFrame:
    """A stream that reads the parts one after the other, each as one batch of so many files."""
    folder, schema = shared_folder(spark, "stream-in"), parts[0].schema
    for k, part in enumerate(parts):  # files are read in the order of their times
        place = f"{folder}/{k:04d}"
        part.repartition(files).write.parquet(place)
        for _ in range(files - len(spark.read.schema(schema).parquet(place).inputFiles())):  # tasks without rows wrote none
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(place)
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run_to_memory(stream: DataFrame, mode: str) -> DataFrame:
    """Run over all input there is, into a table in the driver's memory; for results known to be small."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_appending(stream: DataFrame) -> DataFrame:
    """Run over all input there is, rows written once to Parquet files; the table of these files."""
    spark = stream.sparkSession
    path = shared_folder(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", shared_folder(spark, "stream-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextlib.contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of the streams that start inside, which stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def state_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A value state of a stateful processor as a table of key and value, from the folder of a stream's state."""
    return spark.read.format("statestore").option("path", folder).option("stateVarName", name).load().select("key", "value")


def run_updating(stream: DataFrame, mode: str = "complete", state: str | None = None) -> DataFrame:
    """Run over all input there is; each batch's result replaces the table (complete) or adds to it (update).

    A batch that is run again writes over what it wrote before. state: a folder for the stream's state.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, "stream-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else batch_id}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", state or shared_folder(spark, "stream-state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/*")


def windowed(stream: DataFrame, window: F.Column) -> DataFrame:
    """Counts and sums by a window of event time and event type."""
    return (
        stream.groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("start_at"),
            F.col("w.end").cast("timestamp_ntz").alias("end_at"),
            "event_type", "n", "total",
        )
    )


def running_totals(stream: DataFrame) -> DataFrame:
    """Per user the number of events and the largest value so far, kept in the state store across batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, float("-inf"))
        for frame in frames:
            n, most = n + len(frame), max(most, float(frame["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n long, most double", "n long, most double", "update", GroupStateTimeout.NoTimeout
    )


def rated(spark: SparkSession, rows: int, parts: int = 4) -> DataFrame:
    """Numbers from 0 on as they come at a rate, `rows` a batch: column value."""
    source = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=rows, numPartitions=parts)
    return source.load().select("value")


BUCKETS = 1024  #: keys of stateful processors: a key costs some calls to the state store each batch, so it is many users


def bucket() -> F.Column:
    """The key of a user; null, which is a user of its own, has -1."""
    return F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).cast("long").alias("bucket")


def _users(key: tuple, ids: np.ndarray) -> pd.Series:
    return pd.Series(pd.array(ids, "Int64") if key[0] >= 0 else pd.array([pd.NA] * len(ids), "Int64"))


class Sessions(StatefulProcessor):
    """Sessions of the users of a bucket, closed by event-time timers.

    One value holds the events of sessions that may still grow, one the purchases of each user's closed ones.
    A timer is set to the gap after the earliest end; when the watermark passes it, all sessions that ended a
    gap before are given out, and the earliest end that is left gets its own timer. So events may come in any
    order within the watermark.
    """

    OPEN = ["user_id", "at", "event_id", "event_type"]

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "user_id array<bigint>, at array<bigint>, event_id array<bigint>, event_type array<string>")
        self.closed = handle.getValueState("closed", "user_id array<bigint>, bought array<bigint>")

    def waiting(self) -> pd.DataFrame:
        held = self.open.get() if self.open.exists() else ([], [], [], [])
        kinds = {"user_id": "int64", "at": "int64", "event_id": "int64", "event_type": "object"}
        return pd.DataFrame(dict(zip(self.OPEN, map(list, held), strict=True))).astype(kinds)

    def split(self, events: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of events by user and time: each one's session, and when no event can belong to a session any more, in milliseconds."""
        user, at = events["user_id"].to_numpy(), events["at"].to_numpy()
        starts = np.append(True, (np.diff(user) != 0) | (np.diff(at) > self.gap * 1000))[: len(at)]
        last = np.append(starts[1:], True)[: len(at)]
        return np.cumsum(starts) - 1, at[last] // 1000 + self.gap + 1

    def keep(self, events: pd.DataFrame, ends: np.ndarray) -> None:
        self.open.update(tuple(events[c].tolist() for c in self.OPEN))
        self.handle.registerTimer(int(ends.min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat([self.waiting(), *(frame[self.OPEN] for frame in rows)]).sort_values(["user_id", "at", "event_id"])
        self.keep(events, self.split(events)[1])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = self.waiting()
        session, ends = self.split(events)
        over = ends <= timerValues.getCurrentWatermarkInMs()
        if not over.any():
            if len(ends):
                self.handle.registerTimer(int(ends.min()))
            return
        past = over[session]
        done = events[past].assign(session=session[past], bought=events["event_type"][past] == "purchase")
        made = done.groupby("session").agg(
            user_id=("user_id", "first"), first_at=("at", "first"), last_at=("at", "last"), n=("at", "size"), first_id=("event_id", "first"), own=("bought", "sum")
        )
        before = dict(zip(*self.closed.get(), strict=True)) if self.closed.exists() else {}
        made["bought"] = made.groupby("user_id")["own"].cumsum() + made["user_id"].map(lambda u: before.get(u, 0))
        before.update(made.groupby("user_id")["bought"].last().items())
        self.closed.update(([int(u) for u in before], [int(n) for n in before.values()]))
        if past.all():
            self.open.clear()
        else:
            self.keep(events[~past], ends[~over])
        yield pd.DataFrame({"user_id": _users(key, made["user_id"].to_numpy()), **{c: made[c].to_numpy() for c in ("first_at", "last_at", "n", "first_id", "bought")}})

    def close(self) -> None:
        pass


def timed_sessions(stream: DataFrame, gap_seconds: int) -> DataFrame:
    """user_id, start_at, end_at, n, first_id, bought (the user's purchases so far) of closed sessions."""
    user = F.coalesce("user_id", F.lit(0)).alias("user_id")
    events = stream.where("ts is not null").select(bucket(), user, "ts", F.unix_micros("ts").alias("at"), "event_id", "event_type")
    found = events.groupBy("bucket").transformWithStateInPandas(
        Sessions(gap_seconds * 1000), "user_id long, first_at long, last_at long, n long, first_id long, bought long", outputMode="Append", timeMode="EventTime"
    )
    times = [F.timestamp_micros(f"{c}_at").cast("timestamp_ntz").alias(n) for c, n in (("first", "start_at"), ("last", "end_at"))]
    return found.select("user_id", *times, "n", "first_id", "bought")


class Totals(StatefulProcessor):
    """Per user of a bucket the number of events and the largest value so far; a batch gives the users it has."""

    HELD = ["user_id", "n", "most"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("totals", "user_id array<bigint>, n array<bigint>, most array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).groupby("user_id").agg(n=("user_id", "size"), most=("value", "max")).reset_index()
        both = new
        if self.held.exists():
            before = pd.DataFrame(dict(zip(self.HELD, map(list, self.held.get()), strict=True))).astype({"most": "float64"})
            both = pd.concat([before, new]).groupby("user_id").agg({"n": "sum", "most": "max"}).reset_index()
        self.held.update((both["user_id"].tolist(), both["n"].tolist(), [None if x != x else x for x in both["most"].tolist()]))
        now = both[both["user_id"].isin(new["user_id"])]
        yield pd.DataFrame({"user_id": _users(key, now["user_id"].to_numpy()), "n": now["n"].to_numpy(), "most": now["most"].to_numpy()})

    def close(self) -> None:
        pass


def transformed_totals(stream: DataFrame) -> DataFrame:
    """running_totals by a stateful processor; its state store must be RocksDB's."""
    return stream.select(bucket(), F.coalesce("user_id", F.lit(0)).alias("user_id"), "value").groupBy("bucket").transformWithStateInPandas(
        Totals(), "user_id long, n long, most double", outputMode="Update", timeMode="None"
    )


def held_totals(state: DataFrame) -> DataFrame:
    """user_id, n, most from the state table of the totals."""
    each = state.select("key.bucket", F.explode(F.arrays_zip("value.user_id", "value.n", "value.most")).alias("u"))
    return each.select(F.when(F.col("bucket") >= 0, F.col("u.user_id")).alias("user_id"), "u.n", "u.most")
