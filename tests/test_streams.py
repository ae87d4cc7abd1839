"""Streams, each with a restart: decisions by state and by timers, late answers, refreshes, polling."""

import json
import threading
import time
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.sources import scan
from tidemark.streaming import alerts, answers, refresh


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(spark, folder, schema, build, batches, idle="false"):
    """idle: whether batches without rows run (states by processing time would ask for them for ever). Each batch is a file, and the stream is started anew for each: what it knows is what its checkpoint holds. All rows that came out."""
    (folder / "in").mkdir(exist_ok=True)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", idle)
    try:
        for k, rows in enumerate(batches):
            (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}/in")
            out = lambda rows, n: rows.write.mode("overwrite").parquet(f"file://{folder}/out/n={n}")
            stream = build(source).writeStream.foreachBatch(out).option("checkpointLocation", f"file://{folder}/at").trigger(availableNow=True).start()
            try:
                assert stream.awaitTermination(40)
            finally:
                stream.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(f"file://{folder}/out").drop("n").collect()


def test_decisions_with_a_restart(spark, tmp_path):
    batches = [
        [("ordu", "d1", "noon", "a", 12), ("ordu", "d1", "morning", "a", 22)], [("ordu", "d1", "morning", "a", 9), ("ordu", "d1", "morning", "b", 9)], [("ordu", "d1", "morning", "c", 10), ("ordu", "d1", "noon", "a", 12)],
        [("ordu", "d1", "noon", "z", 12), ("van", "d1", "morning", "q", 9)], [("ordu", "d1", "noon", "y", 13)], [("ordu", "d2", "morning", "a", 9)], [("ordu", "d1", "morning", "late", 9)],
    ]
    names = ("scope", "day", "role", "id", "hour")
    got = run(spark, tmp_path, "scope string, day string, role string, id string, hour int", alerts.decision_stream, [[dict(zip(names, r, strict=True)) for r in b] for b in batches])
    assert sorted(map(tuple, got)) == [("ordu", "d1", "morning", 2), ("ordu", "d1", "noon", 1), ("ordu", "d2", "morning", 1), ("van", "d1", "morning", 1)]


def test_slots_fire_by_timers(spark, tmp_path):
    """09:00 and 12:00 at UTC+3 are 06:00 and 09:00; what comes between is new at noon."""
    at = lambda h: f"2026-10-08T{h:02d}:30:00Z"
    rows = [[("ordu", "a", 4), ("ordu", "b", 4), ("van", "x", 4)], [("ordu", "a", 6), ("ordu", "c", 7)], [("ordu", "c", 8), ("van", "x", 8)], [("of", "k", 10)], [("of", "k", 12)]]
    batches = [[{"scope": s, "day": "2026-10-08", "id": i, "at": at(h)} for s, i, h in b] for b in rows]
    got = run(spark, tmp_path, "scope string, day string, id string, at timestamp", alerts.slot_stream, batches, "true")
    assert {tuple(r) for r in got if r.scope != "of"} == {("ordu", "2026-10-08", "morning", 2), ("ordu", "2026-10-08", "noon", 1), ("van", "2026-10-08", "morning", 1)}
    assert alerts.Slots.slot_ms("2026-10-08", 9) == datetime(2026, 10, 8, 6, tzinfo=timezone.utc).timestamp() * 1000


def event(client, number, scope, body=None):
    return {"client": client, "number": number, "scope": scope, "answered": body is not None, "body": body}


def test_late_answers(spark, tmp_path):
    """An answer for another address is dropped, and the first address's old answer also once that is asked for again."""
    batches = [[event("p", 1, "ordu"), event("q", 1, "van")], [event("p", 2, "van"), event("p", 1, "ordu", "old")], [event("p", 3, "ordu"), event("p", 1, "ordu", "older")], [event("p", 2, "van", "late"), event("p", 3, "ordu", "new"), event("q", 1, "van", "own")]]
    got = run(spark, tmp_path, answers.EVENT, answers.latest_only, batches)
    assert sorted((r.client, r.number, r.body) for r in got) == [("p", 3, "new"), ("q", 1, "own")]
    told = [{**e, "at": k} for k, b in enumerate(batches) for e in b]
    batch = answers.in_force(spark.createDataFrame(told, answers.EVENT + ", at int"))
    assert sorted((r.client, r.number, r.body) for r in batch.collect()) == [("p", 3, "new"), ("q", 1, "own")]


FEED = "id string, place long, scope string, key string, age int, days array<int>, corrects string"


def test_refreshes_follow_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    base = spark.createDataFrame([("b1", 0, "s", "ali", 60, [1]), ("b2", 1, "s", "can", 50, [1])], FEED.replace(", corrects string", ""))
    one = spark.createDataFrame([("f1", 0, "s", "veli", 40, [5], None), ("f2", 1, "s", "ali", 61, [2], None)], FEED)
    two = spark.createDataFrame([("f3", 0, "s", "veli", 41, [6], None), ("f4", 1, "s", "can", 50, [9], "b2")], FEED)
    ids = lambda df: sorted((r.id, r.change) for r in df.collect())
    assert ids(refresh.refresh(base, one, 0, path)) == [("b1", "added"), ("b2", "added"), ("f1", "added")]
    assert ids(refresh.refresh(base, two, 1, path)) == [("b2", "removed"), ("f4", "added")]  # f1 shuts f3 out
    first = sorted(map(str, refresh.result(spark, path).collect()))
    assert ids(refresh.refresh(base, two, 1, path)) == [("b2", "removed"), ("f4", "added")]  # run again: the same
    assert sorted(map(str, refresh.result(spark, path).collect())) == first
    assert ids(refresh.refresh(base, one, 0, path)) == [("b1", "added"), ("b2", "added"), ("f1", "added")] and sorted(map(str, refresh.result(spark, path).collect())) == first
    assert ids(refresh.refresh(base, one.limit(0), 2, path)) == []  # the correction stays in force over a base that has its target


def test_a_refresh_that_broke_off(spark, tmp_path):
    """A version without its mark of success doesn't count; the batch that runs again starts from the one before."""
    path = f"file://{tmp_path}/state"
    base = spark.createDataFrame([("b1", 0, "s", "ali", 60, [1])], FEED.replace(", corrects string", ""))
    feed = lambda i: spark.createDataFrame([(i, 0, "s", i, 40, [5], None)], FEED)
    refresh.refresh(base, feed("f1"), 0, path)
    refresh.refresh(base, feed("f2"), 1, path)
    (tmp_path / "state/result/version=1/_SUCCESS").unlink()
    assert sorted(r.id for r in refresh.result(spark, path).collect()) == ["b1", "f1"]
    refresh.refresh(base, feed("f2"), 1, path)
    assert sorted(r.id for r in refresh.result(spark, path).collect()) == ["b1", "f1", "f2"]


def test_refreshes_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0, "s", "k", None, [1])], FEED.replace(", corrects string", "")).write.parquet(f"file://{tmp_path}/base")
    (tmp_path / "in").mkdir()
    rows = [[("b", 0, "s", "k", None, [2], None), ("c", 1, "s", "j", None, [1], None)], [("d", 0, "s", "j", None, [2], None)]]
    for k, part in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("id", "place", "scope", "key", "age", "days", "corrects"), r, strict=True))) for r in part))
        source = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        stream = refresh.refreshes(source, f"file://{tmp_path}/base", f"file://{tmp_path}/state").option("checkpointLocation", f"file://{tmp_path}/at").start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
    assert sorted(r.id for r in refresh.result(spark, f"file://{tmp_path}/state").collect()) == ["a", "c"]


def test_polling_by_age(spark, tmp_path):
    """A local server: every province once in a span, again in the next; a restart within a span asks nothing."""
    asked = []

    class Gate(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            code = 404 if "van" in self.path else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b'{"il": "Ordu", "ilceler": {}}' if code == 200 else b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Gate)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    where = {"Ordu": f"{at}/ordu.json", "Van": f"{at}/van.json", "Rize": "http://127.0.0.1:9/rize.json"}
    age = 3600.0

    def start():
        out = lambda rows, n: rows.write.mode("append").parquet(f"file://{tmp_path}/out")
        return scan.poll(spark, where, age=age, timeout=5).writeStream.foreachBatch(out).option("checkpointLocation", f"file://{tmp_path}/at").start()

    if time.time() % age > age - 120:
        age = 7200.0
    try:
        for _ in range(2):  # the second start lies in the same span
            stream = start()
            stream.processAllAvailable()
            stream.stop()
        rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
        assert sorted((r.province, r.code) for r in rows if r.code) == [("Ordu", 200), ("Van", 404)] and [r.province for r in rows if r.code is None] == ["Rize"]
        assert sorted(asked) == ["/ordu.json", "/van.json"]
        reader = scan.PollReader({"addresses": json.dumps(where), "age": "0.2"})
        first = reader.latestOffset()
        time.sleep(0.25)
        second = reader.latestOffset()
        assert second["from_ms"] > first["from_ms"] and len(reader.partitions(first, second)) == 3 and reader.partitions(second, second) == []
    finally:
        server.shutdown()
