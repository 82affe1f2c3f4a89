"""Keyed state as streams."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import routing
from millrace.plans import stores
from millrace.streaming import ingest, states


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def collected(stream, at):
    out = []
    stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).start().awaitTermination()
    return out


def test_once(spark, tmp_path):
    schema, path, at = "k long, s string, v long", f"{tmp_path}/in", f"{tmp_path}/check"
    stream = lambda: states.once(spark.readStream.schema(schema).parquet(path), ["k"])
    put(spark, path, [(1, "x", 2), (1, "x", 1), (2, None, None), (2, None, 5), (None, "n", 1)], schema)
    assert sorted(collected(stream(), at), key=str) == sorted([(1, "x", 1), (2, None, None), (None, "n", 1)], key=str)
    put(spark, path, [(1, "a", 0), (None, "a", 0), (3, "y", 1)], schema)
    assert collected(stream(), at) == [(3, "y", 1)]
    assert collected(stream(), at) == []


def test_ingest_beside_a_table(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/out"
    src.mkdir()
    ingest.append_new(spark.createDataFrame([(1, 7), (2, 7)], "k long, v long"), out, ["k"])
    write = lambda n, keys: (src / f"{n}.json").write_text("".join(json.dumps({"k": k, "v": n}) + "\n" for k in keys))
    write(0, [2, 3])
    for n in range(1, 3):  # a fresh checkpoint, then its next run
        ingest.ingest(spark, str(src), "k long, v long", out, ["k"], f"{tmp_path}/check").awaitTermination()
        write(n, [1, 3, 3 + n])
    ingest.ingest(spark, str(src), "k long, v long", out, ["k"], f"{tmp_path}/other").awaitTermination()
    assert sorted(map(tuple, ingest.read_ingested(spark, out).collect())) == [(1, 7), (2, 7), (3, 0), (4, 1), (5, 2)]


T0 = datetime(2024, 1, 1)
EVENT = "u string, id long, ts timestamp, t string"


def test_states_in_order_and_late_rows(spark, tmp_path):
    path, at = f"{tmp_path}/in", f"{tmp_path}/check"
    m = lambda n: T0 + timedelta(minutes=n)
    stream = lambda: states.class_states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path), "u", "ts", "id", F.col("t") == "error", F.col("t") == "done")
    put(spark, path, [("r", 1, m(0), "error"), ("r", 2, m(30), "ok"), ("r", 9, None, "ok")], EVENT)
    put(spark, path, [("r", 3, m(10), "error"), ("r", 4, m(180), "done"), (None, 8, m(1), None)], EVENT)  # id 3 comes late, but in time
    first = collected(stream(), at)
    put(spark, path, [("r", 5, m(60), "error"), ("r", 6, m(240), "error"), ("q", 7, m(360), "ok")], EVENT)  # id 5 comes too late: the watermark is at 120
    rest = collected(stream(), at)  # goes on where the checkpoint ended
    seen = [(r[0], r[1], *r[3:]) for r in first + rest]
    assert [s for s in seen if s[0] == "r"] == [("r", 1, 0, 1, None), ("r", 3, 0, 2, None), ("r", 2, 0, 2, 2), ("r", 4, 0, 2, 4), ("r", 6, 1, 1, None)]
    assert [s for s in seen if s[0] is None] == [(None, 8, 0, 0, 8)] and len(seen) == 6  # id 7 waits for later rows


def test_states_as_the_batch_gives_them(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = [(f"u{r.randrange(5)}", i, T0 + timedelta(seconds=r.randrange(20_000)), r.choice(["error", "ok", "ok", "done"])) for i in range(300)]
    rows += [(f"u{i}", 900 + i, T0 + timedelta(days=1), "ok") for i in range(5)] + [rows[7]]
    for n in range(4):
        lo, hi = 6_000 * n, 6_000 * (n + 1) if n < 3 else 10**9
        put(spark, f"{tmp_path}/in", [x for x in rows if lo <= ((x[2] - T0).total_seconds() + x[1] % 1800) < hi], EVENT)
    bad, done = F.col("t") == "error", F.col("t") == "done"
    got = collected(states.class_states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "u", "ts", "id", bad, done), f"{tmp_path}/check")
    batch = routing.class_states(spark.createDataFrame(rows, EVENT), "u", ["ts", "id"], bad, done, "id").where("id < 900")
    assert sorted((x[0], x[1], *x[3:]) for x in got) == sorted(tuple(x) for x in batch.select("u", "id", "class_index", "attempts", "last_good").collect())


def test_states_of_many_runs_lie_in_few_blocks(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [(None if u == 7 else f"u{u}", 100 * n + u, T0 + timedelta(minutes=n), "done" if n == 2 else "error") for u in range(60) for n in range(4)]
    put(spark, path, rows, EVENT)
    put(spark, path, [("z", 9_999, T0 + timedelta(days=1), "ok")], EVENT)
    bad, done = F.col("t") == "error", F.col("t") == "done"
    got = []
    stream = states.class_states(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path), "u", "ts", "id", bad, done, blocks=3)
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).start()
    q.awaitTermination()
    assert len(got) == 240 and sorted({(x[0], *x[3:5]) for x in got if x[0] in (None, "u1")}, key=str) == sorted({(u, *x) for u in (None, "u1") for x in ((0, 1), (0, 2), (1, 1))}, key=str)
    assert 0 < max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress) < 20  # 3 blocks with their timers, not 60 runs


def test_events_arrive_in_as_many_files_as_they_need(spark):
    sf = "/root/testdata/sf0.001"
    stream = stores._arriving(spark, sf, file_rows=40)
    bad, done = F.col("event_type") == "error", F.col("event_type") == "purchase"
    got = stores._streamed(spark, states.class_states(stream, "user_id", "ts", "event_id", bad, done), "test-states").select("run", "id", "class_index", "attempts", "last_good")
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    passed = e.where(F.col("ts") < e.agg(F.max("ts")).first()[0] - timedelta(hours=1))
    batch = routing.class_states(passed, "user_id", ["ts", "event_id"], bad, done, "event_id").select("user_id", "event_id", "class_index", "attempts", "last_good")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
