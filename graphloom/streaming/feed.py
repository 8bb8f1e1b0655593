"""The daily feed as one streaming query, and keyed freshness of sensors.

Batch and stream share the column logic: trigger, draft, verification against the edge table, route."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from graphloom.streaming.seen import leave_out_seen, remember

TAG = r"\[S2:([A-Za-z0-9_]+)\]"


def triggered(items: DataFrame, tracked: list[str], floor_year: int) -> DataFrame:
    """Items (id, title, year, topics, references) of a tracked topic that are new enough."""
    return items.filter(F.arrays_overlap("topics", F.array(*map(F.lit, tracked))) & (F.coalesce("year", F.lit(0)) >= floor_year))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return items.join(seen.select("id").distinct(), "id", "left_anti")


def drafted(items: DataFrame) -> DataFrame:
    """A draft text with the item's own tag and one for each reference."""
    tags = F.transform("references", lambda r: F.concat(F.lit("[S2:"), r, F.lit("]")))
    return items.withColumn("draft", F.concat_ws(" ", F.col("title"), F.concat(F.lit("[S2:"), F.col("id"), F.lit("]")), F.array_join(tags, " ")))


def verified(drafts: DataFrame, edges: DataFrame) -> DataFrame:
    """Drafts with ``flags``, the cited ids without an edge from the item, and the route: digest if there are none."""
    cited = drafts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("draft", F.lit(TAG), F.lit(1)))).alias("dst")).filter("id <> dst")
    missing = cited.join(edges.select(F.col("src").alias("id"), "dst").distinct(), ["id", "dst"], "left_anti")
    flags = missing.groupBy("id").agg(F.array_sort(F.collect_set("dst")).alias("flags"))
    return drafts.join(flags, "id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).withColumn("route", F.when(F.size("flags") == 0, "digest").otherwise("inbox"))


def pass_spans(routed: DataFrame, run_id: str, note: DataFrame | None = None) -> DataFrame:
    """(run_id, name, status, output) of one pass over routed items: the trigger, a maker and a verifier for each item, the connectors'
    counts, and the topics that the tuning step would drop, as its note."""
    span = lambda name, status, output: F.struct(name.alias("name"), status.alias("status"), output.alias("output"))
    ok, grounded = F.lit("ok"), F.size("flags") == 0
    checked = F.to_json(F.struct(grounded.alias("grounded"), F.col("flags").alias("flags")))
    each = routed.select(F.explode(F.array(span(F.concat(F.lit("maker:"), "id"), ok, F.col("draft")), span(F.concat(F.lit("verify:"), "id"), F.when(grounded, "ok").otherwise("error"), checked))).alias("s")).select("s.*")
    count = lambda route: F.count_if(F.col("route") == route).alias(route)
    ends = routed.agg(F.count(F.lit(1)).alias("items"), count("digest"), count("inbox"))
    whole = ends.select(F.explode(F.array(span(F.lit("trigger"), ok, F.to_json(F.struct("items"))), span(F.lit("connectors"), ok, F.to_json(F.struct("digest", "inbox"))))).alias("s")).select("s.*")
    out = each.unionByName(whole)
    if note is not None:
        dropped = note.agg(F.array_join(F.array_sort(F.collect_set("topic")), ", ").alias("output"))
        out = out.unionByName(dropped.select(F.lit("tune_triage").alias("name"), ok.alias("status"), "output"))
    return out.select(F.lit(run_id).alias("run_id"), "*")


def run_feed(stream: DataFrame, edges: DataFrame, tracked: list[str], floor_year: int, out: str, state: str, checkpoint: str, day: str, spans: str | None = None, feedback: DataFrame | None = None):
    """Start the feed: new items of each micro-batch are routed to ``out`` by day and route, and their ids kept in ``state``.

    With ``spans``, a folder, each pass leaves its trace there, with the note of the tuning step if there is ``feedback``. A batch that is replayed after a failure overwrites its own folder, so a restart neither loses nor doubles items."""
    def handle(batch: DataFrame, number: int) -> None:
        fresh = leave_out_seen(batch.dropDuplicates(["id"]), state, number)
        routed = verified(drafted(fresh), edges).withColumn("day", F.lit(day)).persist()
        routed.write.partitionBy("day", "route").mode("overwrite").parquet(f"{out}/batch={number}")
        if spans:
            note = tune_triage(feedback, batch, tracked) if feedback is not None else None
            pass_spans(routed, f"{day}-{number}", note).write.mode("overwrite").parquet(f"{spans}/batch={number}")
        remember(routed, state, number)
        routed.unpersist()

    return triggered(stream, tracked, floor_year).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tune_triage(feedback: DataFrame, items: DataFrame, tracked: DataFrame | list[str]) -> DataFrame:
    """Tracked topics, a table (topic) or a short list, of which an item was deleted and none kept; the last verdict on an item counts."""
    last = feedback.groupBy("item").agg(F.max_by("verdict", "ts").alias("verdict"))
    topics = last.join(items.select(F.col("id").alias("item"), F.explode("topics").alias("topic")), "item")
    judged = topics.groupBy("topic").agg(F.bool_or(F.col("verdict") == "kept").alias("kept"), F.bool_or(F.col("verdict") == "deleted").alias("deleted"))
    if isinstance(tracked, list):
        tracked = feedback.sparkSession.createDataFrame([(t,) for t in tracked], "topic string")
    return judged.filter(~F.col("kept") & F.col("deleted")).select("topic").join(tracked.select("topic"), "topic", "left_semi")


def first_in_window(stream: DataFrame, key: str, ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def freshness(stream: DataFrame, late: str = "5 minutes", stale_minutes: float = 5.0) -> DataFrame:
    """Last reading of each sensor in event time: a session of readings without a stale gap, closed once it is stale."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", f"{int(stale_minutes * 60)} seconds"), "sensor")
        .agg(F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"), F.count(F.lit(1)).alias("readings"))
        .select("sensor", "last_ts", "last_value", "readings")
    )


class _Readings(StatefulProcessor):
    """Last reading and number of readings of a sensor, and a timer in event time that ends them."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us long, last_value double, readings long")

    def _row(self, key: tuple, state: tuple, stale: bool) -> pd.DataFrame:
        last_us, last_value, readings = state
        return pd.DataFrame({"sensor": [key[0]], "last_ts": [pd.Timestamp(last_us, unit="us")], "last_value": [last_value], "readings": [readings], "stale": [stale]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.last.get()) if self.last.exists() else None
        due = None if state is None else state[0] // 1000 + self.keep_ms
        for part in rows:
            newest = part.sort_values(["ts", "value"], na_position="first").iloc[-1]
            at, value = int(newest["ts"].value // 1000), None if pd.isna(newest["value"]) else float(newest["value"])
            low = float("-inf")
            if state is None or (at, low if value is None else value) >= (state[0], low if state[1] is None else state[1]):
                state = (at, value, 0 if state is None else state[2])
            state = (*state[:2], state[2] + len(part))
        now = state[0] // 1000 + self.keep_ms
        if now != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now)
        self.last.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            state = tuple(self.last.get())
            self.last.clear()
            yield self._row(key, state, True)


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB: on the executors' disks with changes in the checkpoint, so it may outgrow their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def current_readings(stream: DataFrame, late: str = "5 minutes", stale_minutes: float = 5.0) -> DataFrame:
    """(sensor, last_ts, last_value, readings, stale): the state of every sensor (sensor, ts, value) that a batch touches, and a last row with
    ``stale`` once event time is ``stale_minutes`` past its last reading, when its state goes.

    The state is one row a sensor, kept in RocksDB (which this sets for the session's next queries), and one timer a sensor; a batch touches the
    sensors it holds and those whose timers end. A reading older than the last one counts but changes nothing, of readings at one time the greatest
    value is the last; rows without a time, and rows behind the watermark, are left out."""
    use_rocksdb(stream.sparkSession)
    return (
        stream.filter("ts is not null").withWatermark("ts", late).groupBy("sensor")
        .transformWithStateInPandas(_Readings(int(stale_minutes * 60_000)), "sensor string, last_ts timestamp, last_value double, readings long, stale boolean", "Append", "EventTime")
    )
