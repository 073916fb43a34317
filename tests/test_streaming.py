import datetime

from lauda.streaming import events as ev

T = datetime.datetime


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_intake_resumes_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    make = lambda n: spark.createDataFrame([(n, T(2024, 1, 1), 1, "a", 1.0, "{}")], ev.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    make(1)
    ev.intake(ev.read_events(spark, src), out, cp).awaitTermination(120)
    make(2)
    ev.intake(ev.read_events(spark, src), out, cp).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_telemetry_and_redelivery(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, T(2024, 1, 1, 0, 5), 1, "a", 1.0, "{}"), (1, T(2024, 1, 1, 0, 5), 1, "a", 1.0, "{}"), (2, T(2024, 1, 1, 0, 30), 1, "a", 2.0, "{}"), (3, T(2024, 1, 1, 3), 1, "b", 5.0, "{}")]
    spark.createDataFrame(rows, ev.EVENT_SCHEMA).coalesce(1).write.parquet(src)
    _run(ev.telemetry(ev.read_events(spark, src)), "telemetry", "complete")
    assert sorted((r.event_type, r.n) for r in spark.table("telemetry").collect()) == [("a", 3), ("b", 1)]
    _run(ev.distinct_events(ev.read_events(spark, src)), "once")
    assert spark.table("once").count() == 3


def test_retry_machine(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("i", True, T(2024, 1, 1, 0)), ("i", True, T(2024, 1, 1, 1)), ("j", True, T(2024, 1, 1)), ("j", False, T(2024, 1, 2)), ("i", True, T(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "item string, failed boolean, at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("item string, failed boolean, at timestamp").parquet(src)
    _run(ev.retry_machine(stream, 3, 60), "retry")
    got = sorted((r.item, r.attempts, r.status, r.next_at) for r in spark.table("retry").collect() if r.status != "done")
    assert got == [("i", 1, "waiting", T(2024, 1, 1, 0, 1)), ("i", 2, "waiting", T(2024, 1, 1, 1, 2)), ("i", 3, "exhausted", None), ("j", 1, "waiting", T(2024, 1, 1, 0, 1))]
