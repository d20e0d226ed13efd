"""Structured Streaming over an event queue: scoring with keyed merges, cache notices, session state, windows.

Files stand for the queue; a broker's source takes their place by format and options alone.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

from ..operators import vectors
from ..sources import buckets, sinks


def read_queue(spark: SparkSession, path: str, schema, files_at_once: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def scored(messages: DataFrame, key: str = "user_id") -> DataFrame:
    """Risk of each message's entity by the stand-in model."""
    score = vectors.stub_risk(F.col(key))
    return messages.withColumns({"risk_score": score, "risk_level": vectors.risk_label(score)})


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The latest row of each key by time, so messages may come in any order."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "ts").alias("r")).select(key, "r.*")


#: What a result of the scoring service holds.
MESSAGE = "patient_id long, risk_score string, risk_level string, ts string"


def parsed(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON texts as (patient_id, risk_score, risk_level, ts) and `fault`: what is wrong with a message, null if nothing is.

    Every cast is a trying one, so a bad message is a row with a fault, never an error of the batch. A missing score or level is no fault: it stays null.
    """
    text = F.col(value)
    j = F.from_json(text, MESSAGE, {"mode": "PERMISSIVE"})
    row = messages.select(text.alias("message"), F.call_function("try_parse_json", text).isNotNull().alias("json"), j.alias("j"))
    score, ts = F.col("j.risk_score").try_cast("double"), F.col("j.ts").try_cast("timestamp")
    fault = F.when(F.col("message").isNull() | ~F.col("json"), "not_json").when(F.col("j.patient_id").isNull(), "no_patient").when(F.col("j.risk_score").isNotNull() & (score.isNull() | F.isnan(score)), "bad_score").when(ts.isNull(), "bad_time")
    return row.select("message", F.col("j.patient_id").alias("patient_id"), score.alias("risk_score"), F.col("j.risk_level").alias("risk_level"), ts.alias("ts"), fault.alias("fault"))


class Consumer:
    """Merges the newest row of each key of a batch into the touched buckets of a table, then tells which keys changed.

    `prepare` turns a batch into rows of the table with, if it likes, a column `fault`: rows with a fault go to the dead letters under `root`/dead, by batch,
    and change nothing else. A batch that was merged before does nothing, also for a consumer that starts anew. Notices of changed keys are
    appended under `root`/notices; a failing listener is logged and doesn't stop the queue. With `enabled` off nothing is started.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schema: StructType | str, prepare: Callable[[DataFrame], DataFrame], notify: Callable[[DataFrame], None] | None = None, enabled: bool = True, n_buckets: int = 64):
        self.spark, self.root, self.key, self.prepare, self.notify, self.enabled = spark, root.rstrip("/"), key, prepare, notify, enabled
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.table = buckets.BucketedTable(spark, f"{self.root}/table", schema, [key], n_buckets) if enabled else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.table.done():
            return
        rows = self.prepare(batch)
        if "fault" in rows.columns:
            rows = sinks.written(rows, "batch")  # good and bad rows are read from one evaluation
            rows.filter("fault IS NOT NULL").write.mode("overwrite").parquet(f"{self.root}/dead/batch={number}")
            rows = rows.filter("fault IS NULL").drop("fault")
        latest = sinks.written(newest(rows.select(*self.table.schema.names), self.key), "latest")
        self.table.merge(latest, buckets.newest_by([self.key], F.col("ts")), number)
        try:
            latest.select(self.key, F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{self.root}/notices/n-{number}")
            if self.notify:
                self.notify(latest.select(self.key))
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).exception("listener of batch %s", number)

    def read(self) -> DataFrame:
        return self.table.read()

    def start(self, messages: DataFrame, checkpoint: str) -> StreamingQuery | None:
        if not self.enabled:
            return None
        return messages.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Faulty messages of all batches of a consumer."""
    return spark.read.schema(StructType([*schema.fields]).add("batch", LongType())).parquet(f"{root.rstrip('/')}/dead")


def clean_cache(notices: DataFrame, cache: sinks.ResultCache, pattern: str, checkpoint: str) -> StreamingQuery:
    """A second stream: any notice of a changed key drops the cached results whose names match the pattern."""

    def drop(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            cache.invalidate_matching(pattern)

    return notices.writeStream.foreachBatch(drop).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Latest events that a session remembers.
REMEMBERED = 20


class Sessions(StatefulProcessor):
    """Events of a session so far and its latest ones, as a value that expires `ttl_ms` after its last update."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "n long, recent string", self.ttl_ms)  # recent: JSON

    def handleInputRows(self, key, rows, timers) -> Iterator:
        import pandas as pd

        n, recent = self.session.get() if self.session.exists() else (0, "[]")
        recent = [tuple(r) for r in json.loads(recent)]
        for pdf in rows:
            n += len(pdf)
            recent = sorted([*recent, *((int(t.value), int(i), str(e)) for t, i, e in zip(pd.to_datetime(pdf["ts"]), pdf["event_id"], pdf["event_type"], strict=True))])[-REMEMBERED:]
        self.session.update((n, json.dumps(recent)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [recent[-1][2]], "oldest": [recent[0][1]]})

    def close(self) -> None:
        pass


#: Where states with a time to live are kept. A value is checked for its age whenever it is read, so a session expires without batches of its own; states
#: of this kind ask for batches without data for ever, and a run to the end of its input would never end.
ROCKS_DB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def session_state(events: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """Running state of each session: events so far, the last type, and the latest REMEMBERED events.

    A session without events for `ttl_ms` of processing time is forgotten: the state store drops its value, and a later event starts it anew.
    The session needs the settings in ROCKS_DB when the query starts.
    """
    return events.groupBy("user_id").transformWithStateInPandas(Sessions(ttl_ms), "user_id long, n long, last string, oldest long", "Update", "ProcessingTime")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extra: counts and sums per window and type. Works on streams and on tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Extra: sessions of a user, ended by a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")
