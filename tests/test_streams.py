"""Merging consumers, dead letters, notices, and sessions that expire."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abundara.sources import buckets, sinks
from abundara.streaming import queue

SCHEMA = "user_id long, risk_score double, risk_level string, ts timestamp"


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.glob("bucket=*/*.parquet")}


def scored(batch):
    return queue.scored(batch, "user_id")


# --- buckets -----------------------------------------------------------------------


def test_a_key_rewrites_its_bucket_alone(spark, tmp_path):
    table = buckets.BucketedTable(spark, str(tmp_path), StructType.fromDDL("k long, v string, at long"), ["k"], 8)
    combine = buckets.newest_by(["k"], F.col("at"))
    rows = spark.createDataFrame([(i, "old", 1) for i in range(100)], table.schema)
    assert len(table.merge(rows, combine)) == 8
    before = files(tmp_path)
    touched = table.merge(spark.createDataFrame([(7, "new", 2), (7, "newer", 3), (7, "older", 0)], table.schema), combine)
    after = files(tmp_path)
    changed = {f.parent.name for f in before.keys() ^ after.keys()} | {f.parent.name for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed == {f"bucket={touched[0]}"} and len(touched) == 1
    assert {r.k: r.v for r in table.read().collect()} == {i: "newer" if i == 7 else "old" for i in range(100)}
    assert table.merge(rows, combine, 1) == [] and table.done() == 1  # merged before
    assert table.merge(rows.filter("false"), combine) == [] and table.done() == 2


def test_a_broken_merge_is_finished(spark, tmp_path, monkeypatch):
    schema = StructType.fromDDL("k long, v string, at long")
    combine = buckets.newest_by(["k"], F.col("at"))
    table = buckets.BucketedTable(spark, str(tmp_path), schema, ["k"], 4)
    table.merge(spark.createDataFrame([(i, "old", 1) for i in range(20)], schema), combine)

    def broken(rows):
        raise OSError("gone")

    monkeypatch.setattr(table, "_overwrite", broken)
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(3, "new", 2)], schema), combine)
    again = buckets.BucketedTable(spark, str(tmp_path), schema, ["k"], 4)
    assert again.done() == 1 and {r.k: r.v for r in again.read().collect()} == {i: "new" if i == 3 else "old" for i in range(20)}
    assert not list(tmp_path.glob("_staged/*")) and not list(tmp_path.glob("_merging/*"))


def test_null_keys_and_upserts(spark, tmp_path):
    schema = StructType.fromDDL("k long, v string, w string")
    table = buckets.BucketedTable(spark, str(tmp_path), schema, ["k"], 4)
    table.merge(spark.createDataFrame([(None, "a", "x"), (1, "b", "y")], schema), buckets.upserted(["k"]))
    table.merge(spark.createDataFrame([(None, "c", "z"), (1, "d", "q"), (2, None, None)], schema), buckets.upserted(["k"], ["v"]))
    assert sorted(map(str, ((r.k, r.v, r.w) for r in table.read().collect()))) == sorted(map(str, [(None, "c", "x"), (1, "d", "y"), (2, None, None)]))


# --- the consumer ------------------------------------------------------------------


def test_stream_equals_batch_and_restarts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    told = []
    consumer = queue.Consumer(spark, str(tmp_path / "t"), "user_id", SCHEMA, scored, notify=lambda keys: told.append(keys.count()), n_buckets=4)
    stream = queue.read_queue(spark, str(tmp_path / "in" / "*"), events.schema, 1)
    consumer.start(stream, str(tmp_path / "cp")).awaitTermination()
    want = {r.user_id: r.ts for r in events.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    assert {r.user_id: r.ts for r in consumer.read().collect()} == want and len(told) == 3
    before = files(tmp_path / "t" / "table")
    consumer(events, 0)  # a batch that was merged before
    again = queue.Consumer(spark, str(tmp_path / "t"), "user_id", SCHEMA, scored, notify=lambda keys: 1 / 0, n_buckets=4)
    again(events, 2)
    assert files(tmp_path / "t" / "table") == before
    again(events, 3)  # its listener fails, the table stays
    assert again.table.done() == 3 and {r.user_id: r.ts for r in again.read().collect()} == want
    assert queue.Consumer(spark, "x", "user_id", SCHEMA, scored, enabled=False).start(stream, "z") is None


GOOD = '{"patient_id": 1, "risk_score": 0.5, "risk_level": "LOW", "ts": "2024-01-01 00:00:00"}'
BAD = [None, "", "not json", '{"patient_id": null, "ts": "2024-01-01"}', '{"patient_id": 2, "risk_score": "n/a", "ts": "2024-01-01"}', '{"patient_id": 2, "risk_score": "1e", "ts": "2024-01-01"}', '{"patient_id": 2, "ts": "yesterday"}', '{"patient_id": 2}', GOOD[:-1]]


def test_one_bad_message_changes_nothing_else(spark, tmp_path):
    rows = [(m,) for m in [*BAD, GOOD, GOOD.replace("0.5", '"0.75"').replace(" 00:", " 01:"), '{"patient_id": 3, "ts": "2024-01-02", "more": [1]}']]
    consumer = queue.Consumer(spark, str(tmp_path), "patient_id", "patient_id long, risk_score double, risk_level string, ts timestamp", queue.parsed, n_buckets=2)
    batch = spark.createDataFrame(rows, "value string")
    consumer(batch, 0)
    assert sorted((r.patient_id, r.risk_score) for r in consumer.read().collect()) == [(1, 0.75), (3, None)]
    schema = StructType.fromDDL("message string, fault string")
    dead = [(r.message, r.fault) for r in queue.dead_letters(spark, str(tmp_path), schema).collect()]
    assert sorted(str(m) for m, _ in dead) == sorted(str(m) for m in BAD)
    assert {f for m, f in dead if m is None or "{" not in m or m == GOOD[:-1]} == {"not_json"}
    assert sorted(f for _, f in dead if f != "not_json") == ["bad_score", "bad_score", "bad_time", "bad_time", "no_patient"]
    consumer(batch, 0)
    assert queue.dead_letters(spark, str(tmp_path), schema).count() == len(BAD)


def test_an_update_drops_cached_results(spark, tmp_path):
    schema = "patient_id long, risk_score double, risk_level string, ts timestamp"
    consumer = queue.Consumer(spark, str(tmp_path / "c"), "patient_id", schema, queue.parsed, n_buckets=2)
    batch = lambda m: spark.createDataFrame([(m,)], "value string")
    consumer(batch(GOOD), 0)
    cache = sinks.ResultCache()
    look = lambda: {r.patient_id: r.risk_score for r in cache.get("search:risk", consumer.read).collect()}
    cache.get("other", lambda: spark.range(1))
    notices = lambda: queue.read_queue(spark, str(tmp_path / "c" / "notices" / "*"), StructType.fromDDL("patient_id long, batch long"))
    queue.clean_cache(notices(), cache, "search:*", str(tmp_path / "seen")).awaitTermination()
    assert look() == {1: 0.5}
    queue.clean_cache(notices(), cache, "search:*", str(tmp_path / "seen")).awaitTermination()
    assert any(k.startswith("search:") for k in cache.kept)  # no new notice
    consumer(batch(GOOD.replace("0.5", "0.9").replace(" 00:", " 02:")), 1)
    queue.clean_cache(notices(), cache, "search:*", str(tmp_path / "seen")).awaitTermination()
    assert [k for k in cache.kept] == ["other:{}"] and look() == {1: 0.9}


# --- sessions ----------------------------------------------------------------------


def test_a_silent_session_is_forgotten(spark, tmp_path, monkeypatch):
    events = lambda *rows: spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts timestamp")
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for k, v in queue.ROCKS_DB.items():
        spark.conf.set(k, v)
    try:
        folder, out = str(tmp_path / "in"), []

        def run(rows, ttl_ms=600_000):
            rows.coalesce(1).write.mode("append").parquet(folder)
            stream = queue.session_state(queue.read_queue(spark, folder, rows.schema), ttl_ms)
            stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            found, out[:] = {r.user_id: (r.n, r.last, r.oldest) for r in out}, []
            return found

        assert run(events((1, 10, "a", at(1)), (2, 20, "b", at(1)), (1, 11, "c", at(2)))) == {1: (2, "c", 10), 2: (1, "b", 20)}
        assert run(events((1, 9, "late", at(0))), ttl_ms=1_000) == {1: (3, "c", 9)}
        time.sleep(2)
        assert run(events((1, 12, "d", at(3)))) == {1: (1, "d", 12)}  # silent for longer than the time to live: anew
        assert run(events((1, 13, "e", at(4)))) == {1: (2, "e", 12)}
    finally:
        for k in queue.ROCKS_DB:
            spark.conf.unset(k)
