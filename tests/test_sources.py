"""Files, topics, stored documents, and streams against batches."""

import json
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, convert
from millrace.operators.windows import TimeWindow, closed
from millrace.sources import files, store
from millrace.sources.kafka import Kafka
from millrace.sources.topics import Broker
from millrace.streaming import query, stateful
from millrace.streaming.metrics import Stats


def test_csv_is_text_and_streams_alike(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("﻿id,v\n1,2.5\n2,x\n3,\n", encoding="utf-8")
    df = files.csv(spark, str(tmp_path / "in"))
    assert df.columns == ["id", "v"] and {f.dataType.simpleString() for f in df.schema} == {"string"} and df.count() == 3
    prepare = lambda d: clean.clean(convert.convert(d, {"id": "int", "v": "float"}), [clean.Rule("id", max_value=2)])
    stream = files.csv_stream(spark, str(tmp_path / "in"), ["id", "v"], 1)
    status = query.start(prepare(stream), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad")).wait()
    assert not status["running"] and status["rows"] == 3
    want = {r.id for r in prepare(df).where("_valid").collect()}
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want == {1}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_broker(spark, tmp_path):
    b = Broker(spark, f"file:{tmp_path}")
    rows = spark.createDataFrame([(i, json.dumps({"row": i})) for i in range(5)], "i long, value string")
    assert b.publish(rows, "Stream-Exchange", "a", order="i") == 5
    assert b.publish(rows.limit(2), "Stream-Exchange", "b", order="i") == 2
    topic = b.topic_for("Stream-Exchange", "a")
    assert [json.loads(r.value)["row"] for r in b.peek(topic, 3).collect()] == [0, 1, 2]
    got = b.fetch(topic, "g", 2)
    assert [r._delivery.offset for r in got.collect()] == [0, 1]
    b.nack(got, "g", requeue=True)
    assert [r._delivery.offset for r in b.fetch(topic, "g", 2).collect()] == [0, 1]
    b.ack(got, "g")
    b.nack(b.fetch(topic, "g", 1).cache(), "g", reason="bad")
    assert [r._delivery.offset for r in b.fetch(topic, "g", 10).collect()] == [3, 4]
    dead = json.loads(b.peek(f"{topic}__dlq").first().value)
    assert dead["row"] == 2 and dead["_dead_letter"]["reason"] == "bad" and dead["_dead_letter"]["offset"] == 2 and dead["_dead_letter"]["source_topic"] == topic
    assert {r.topic: r.depth for r in b.backlog().collect()}[topic] == 5
    assert [r.routing_key for r in b.bindings("Stream-Exchange").collect()] == ["a", "a__dlq", "b"]


def test_dead_letters_of_any_payload(spark, tmp_path):
    b = Broker(spark, f"file:{tmp_path}")
    values = ["{}", ' {"a": "}"} ', "[1]", "text", None]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, value string")
    b.publish(rows, "x", "y", order="i")
    b.nack(b.fetch("x__y", "g", 10).cache(), "g")
    dead = [json.loads(r.value) for r in b.peek("x__y__dlq").collect()]
    assert [d["_dead_letter"]["reason"] for d in dead] == ["rejected"] * 5 and [d["_dead_letter"]["offset"] for d in dead] == [0, 1, 2, 3, 4]
    assert [{k: v for k, v in d.items() if k != "_dead_letter"} for d in dead] == [{}, {"a": "}"}, {"payload": "[1]"}, {"payload": "text"}, {}]


def test_offsets_over_many_partitions(spark, tmp_path):
    """Offsets are dense and in order, whatever ranges the rows are dealt to; batches go on from the last."""
    b = Broker(spark, f"file:{tmp_path}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k in range(2):
            rows = spark.range(300).select((F.col("id") + 300 * k).alias("i"), F.to_json(F.struct("id")).alias("value")).repartition(7)
            assert b.publish(rows, "e", "k", partitions=3, order="i") == 300
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per = {}
    for r in b.records().orderBy("partition", "offset").collect():
        per.setdefault(r.partition, []).append((r.offset, json.loads(r.value)["id"]))
    assert len(per) == 3 and sum(map(len, per.values())) == 600
    for rows in per.values():
        assert [o for o, _ in rows] == list(range(len(rows)))
        half = len(rows) // 2
        assert [v for _, v in rows[:half]] == sorted(v for _, v in rows[:half])
    stats = b.stats().first()
    assert (stats.topic, stats.messages, stats.partitions) == ("e__k", 600, 3) and stats.per_second > 0
    bad = spark.createDataFrame([('{"a": 1}',), ("no json",), (None,), ("[1]",)], "value string")
    assert b.publish_batch(bad, "e", "z") == (1, 3)
    b.ack(b.fetch("e__k", "g", 5).cache(), "g")
    b.unsubscribe("e__k", "g")
    assert b.fetch("e__k", "g", 1).first()._delivery.offset == 0


def test_kafka_options(spark):
    k = Kafka("host:9092", {"kafka.security.protocol": "SSL"})
    assert k.producer()["kafka.acks"] == "all" and k.producer()["kafka.bootstrap.servers"] == "host:9092"
    got = k.consumer(["a", "b"], {"a": {0: 5}}, 100)
    assert got["subscribe"] == "a,b" and json.loads(got["startingOffsets"]) == {"a": {"0": 5}} and got["maxOffsetsPerTrigger"] == "100" and got["kafka.security.protocol"] == "SSL"
    m = k.messages(spark.createDataFrame([(1, "x")], "i long, s string"), F.lit("t"), F.col("i")).first()
    assert (m.key, json.loads(m.value), m.topic) == ("1", {"i": 1, "s": "x"}, "t")


def test_row_estimate(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,v\n" + "".join(f"{i:05d},xyz\n" for i in range(2000)))
    assert abs(files.estimated_rows(spark, str(tmp_path / "in")) - 2000) <= 5
    (tmp_path / "q.csv").write_text('id,v\n1,"two\nlines"\n')
    assert [r.v for r in files.csv(spark, str(tmp_path / "q.csv"), multiline=True).collect()] == ["two\nlines"]


def test_stream_status_reset_and_reconfiguration(spark, tmp_path):
    e = spark.range(40).select(F.col("id").cast("string").alias("id"), (F.col("id") % 4).cast("string").alias("v"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stats = Stats.attached(spark)
    plan = lambda most: lambda cp: query.start(clean.clean(convert.convert(files.parquet_stream(spark, str(tmp_path / "in")), {"v": "int"}), [clean.Rule("v", max_value=most)]), str(tmp_path / "out"), cp, str(tmp_path / "bad"))
    run = plan(1)(str(tmp_path / "cp"))
    status = run.wait()
    assert (status["published"], status["failed"], status["rows"], status["success_rate"]) == (20, 20, 40, 0.5)
    again = run.reconfigured(plan(2))
    assert again.wait()["rows"] == 0  # nothing new since the checkpoint
    again.reset()
    assert (lambda s: (s["published"], s["failed"]))(plan(2)(str(tmp_path / "cp")).wait()) == (30, 10)
    e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = plan(2)(str(tmp_path / "cp"))
    live.wait()
    polled = query.append(files.parquet_stream(spark, str(tmp_path / "in")), str(tmp_path / "o2"), str(tmp_path / "c2"), interval=0.2)
    for _ in range(100):
        if polled.status()["rows"] == 80:
            break
        time.sleep(0.2)
    assert polled.status()["running"] and not polled.stop()["running"] and spark.read.parquet(str(tmp_path / "o2")).count() == 80
    spark.streams.removeListener(stats)
    assert stats.summary()["rows"] >= 80 and stats.summary()["success_rate"] == 1.0


def test_stream_state_is_exact_for_large_offsets(spark, tmp_path):
    e = spark.range(60).select("id", F.lit("k").alias("k"), (F.lit(1e9) + F.col("id") % 3).alias("v"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    query.append(stateful.running(files.parquet_stream(spark, str(tmp_path / "in")), ["k"], "v", "id", "a"), str(tmp_path / "o"), str(tmp_path / "c")).wait()
    last = spark.read.parquet(str(tmp_path / "o")).orderBy(F.desc("id")).first()
    assert abs(last.a_std - (2 / 3) ** 0.5) < 1e-9 and last.a_mean == 1e9 + 1 and last.a_count == 60


def test_late_rows_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    for k, hours in enumerate(([0, 1, 10], [0, 11])):
        spark.createDataFrame([(h * 3600, 1.0) for h in hours], "s long, v double").select(F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(folder))
        w = TimeWindow("w", "v", "ts", "tumbling", 3600.0, functions=["count"])
        status = query.append(stateful.at_close(files.parquet_stream(spark, str(folder)), w, 0), str(tmp_path / "o"), str(tmp_path / "c")).wait()
    assert status["late_rows"] == 1


def test_config_store(spark, tmp_path):
    s = store.ConfigStore(spark, f"file:{tmp_path}/config")
    assert s.get("a") is None and s.upsert("a", {"x": 1}, "first") == 1 and s.upsert("a", {"x": 2}) == 2
    assert s.get("a") == {"service_name": "a", "config": {"x": 2}, "version": 2, "description": "first"}
    assert s.seed({"a": {}, "b": {"y": 1}}) == 1 and [r.service_name for r in s.list_all().collect()] == ["a", "b"]
    assert s.delete("a") and not s.delete("a") and s.get("a") is None
    assert s.upsert("a", {"x": 3}) == 1 and s.get("a") == {"service_name": "a", "config": {"x": 3}, "version": 1, "description": None} and s.upsert("a", {"x": 4}) == 2


def test_page(spark):
    rows, info = store.page(spark.range(41), 3, 20, "id")
    assert info["total_pages"] == 3 and [r.id for r in rows.collect()] == [40]
    assert store.page(spark.range(0), 1, 20, "id")[1]["total_pages"] == 0


def test_streams_agree_with_batches(spark, tmp_path):
    e = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 1.5).alias("v"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = files.parquet_stream(spark, str(tmp_path / "in"))
    query.append(stateful.running(live, ["k"], "v", "id", "a"), str(tmp_path / "o1"), str(tmp_path / "c1")).wait()
    last = spark.read.parquet(str(tmp_path / "o1")).groupBy("k").agg(F.max("a_count").alias("n"), F.max_by("a_sum", "id").alias("s")).collect()
    want = {r.k: (r.n, r.s) for r in e.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect()}
    assert {r.k: (r.n, r.s) for r in last} == want
    w = TimeWindow("w", "v", "ts", "tumbling", 3600.0, functions=["count"])
    query.append(stateful.at_close(live, w, 0), str(tmp_path / "o2"), str(tmp_path / "c2")).wait()
    batch = {(r.window_start, r.w_count) for r in closed(e, w).collect()}
    got = {(r.window_start, r.w_count) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert got < batch and len(batch - got) <= 2  # the last windows stay open
    query.append(stateful.dedup(live, ["k"], "ts", "1 day").select("k"), str(tmp_path / "o3"), str(tmp_path / "c3")).wait()
    assert spark.read.parquet(str(tmp_path / "o3")).count() == 7


def test_collection_and_states(spark, tmp_path):
    c = store.Collection(spark, f"file:{tmp_path}/docs", "kind string, v bigint")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3)], "_id string, kind string, v long")
    assert c.save(rows) == 3 and c.count({"kind": "x"}) == 2 and c.find_one({"_id": "b"})["v"] == 2
    assert c.update({"kind": "x"}, {"v": 9}) == 2 and [r.v for r in c.find(sort=["_id"]).collect()] == [9, 9, 3]
    assert {r.kind: r.n for r in c.counts("kind").collect()} == {"x": 2, "y": 1} and c.update({"kind": None}, {"v": 0}) == 0
    assert c.delete({"_id": "a"}) == 1 and c.count() == 2 and c.find_one({"_id": "a"}) is None
    s = store.StateStore(spark, f"file:{tmp_path}/states", most=2)
    assert [s.save("m", {"k": i}) for i in range(3)] == [1, 2, 3] and s.load("m") == {"k": 2} and s.load("m", 1) is None and s.names().first().versions == 2


def test_writes_are_numbered_not_timed(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    at = f"file:{tmp_path}/claims"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: store.claimed(spark, at), range(24)))
    assert sorted(got) == list(range(1, 25)) and store.claimed(spark, at, 100) == 100
    s = store.ConfigStore(spark, f"file:{tmp_path}/config")
    assert s.upsert("a", {"x": 1}) == 1 and s.upsert("a", {"x": 2}, expected=1) == 2
    with pytest.raises(ValueError, match="version 2"):
        s.upsert("a", {"x": 3}, expected=1)
    assert s.delete("a") and s.get("a") is None and s.upsert("a", {"x": 4}) == 1 and s.get("a")["config"] == {"x": 4}
    c = store.Collection(spark, f"file:{tmp_path}/docs", "v bigint")
    c.save(spark.createDataFrame([("p", 1), ("q", 5), ("p", 2), ("p", 3)], "_id string, v bigint").coalesce(1))
    assert sorted((r._id, r.v) for r in c.current().collect()) == [("p", 3), ("q", 5)]
    m = store.StateStore(spark, f"file:{tmp_path}/models")
    assert [m.save("m", {"w": k}) for k in range(3)] == [1, 2, 3] and m.load("m")["w"] == 2


def test_groups_consume_at_their_own_pace(spark, tmp_path):
    b = Broker(spark, f"file:{tmp_path}/broker")
    values = lambda ks: spark.createDataFrame([(json.dumps({"k": k}),) for k in ks], "value string")
    b.publish(values(range(10)), "ex", "k", order="value")
    topic, seen = b.topic_for("ex", "k"), {"one": [], "two": []}

    def handler(group, fail_at=None):
        def handle(rows):
            got = rows.withColumn("k", F.get_json_object("value", "$.k").cast("int"))
            ks = sorted(r.k for r in got.collect())
            if fail_at in ks:
                raise RuntimeError("the consumer died")
            seen[group].append(ks)
            verdict = F.when(F.col("k") % 5 == 3, "nack").when((F.col("k") == 4) & F.lit(len(seen[group]) == 1), "requeue").otherwise("ack")
            return got.select("partition", "offset", verdict.alias("verdict"), F.lit("bad").alias("reason"))

        return handle

    status = b.consume(topic, "one", handler("one")).wait()
    assert seen["one"] == [list(range(10))] and (status["published"], status["failed"]) == (7, 3)
    b.publish(values(range(10, 14)), "ex", "k", order="value")
    with pytest.raises(Exception, match="died"):
        b.consume(topic, "one", handler("one", fail_at=12)).wait()
    b.consume(topic, "one", handler("one")).wait()  # what had not ended comes again, with the requeued record, and nothing else
    assert seen["one"][1:] == [[4, 10, 11, 12, 13]]
    b.consume(topic, "two", handler("two"), prefetch=1).wait()  # the other group begins at the first record
    assert sorted(k for ks in seen["two"] for k in ks if k != 4) == [k for k in range(14) if k != 4] and len(seen["two"]) >= 2
    dead = sorted((r.group_id, json.loads(r.value)["k"], json.loads(r.value)["_dead_letter"]["reason"]) for r in b.dead(topic).collect())
    assert dead == [(g, k, "bad") for g in ("one", "two") for k in (3, 8, 13)]


def test_observed_metrics_of_batches_and_streams(spark, tmp_path):
    from millrace.operators import observed
    from millrace.streaming.metrics import MetricsTable

    df = spark.createDataFrame([("1", 1.0), ("x", None), (None, 3.0)], "a string, v double")
    out = observed.converted(df, {"a": "int"})
    out.df.write.format("noop").mode("overwrite").save()
    assert [tuple(r) for r in out.table().collect()] == [("a", 1, 1)]
    out = observed.imputed(df, ["v"], strategy="fill_mean")
    assert sorted(r.v for r in out.df.collect()) == [1.0, 2.0, 3.0]
    assert [tuple(r) for r in out.table().collect()] == [("v", 3, 1, 1, 0)]
    for k in range(2):
        df.write.mode("append").parquet(f"{tmp_path}/in")
    table = MetricsTable.attached(spark, f"file:{tmp_path}/metrics")
    try:
        rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("n"), F.count("v").alias("v"))
        query.append(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint").wait()
        for _ in range(50):
            if table.totals().count() == 2 and table.batches().agg(F.sum("rows")).first()[0] == 6:
                break
            time.sleep(0.2)
        assert {r.metric: r.total for r in table.totals().collect()} == {"n": 6.0, "v": 4.0}
        assert table.batches().select("batch").distinct().count() == table.batches().count()
    finally:
        spark.streams.removeListener(table)
