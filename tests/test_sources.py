import json

import pytest
from conftest import rows

from millrace.sources import paged
from millrace.streaming import events as streams


def test_pages_until_a_short_one():
    import fake_api

    assert [o for o, _ in paged.pages(fake_api.fetch)] == list(range(250))
    with pytest.raises(ValueError, match="list"):
        list(paged.pages(fake_api.wrong))


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise paged.Retryable("busy")
        return "ok"

    assert paged.with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 2 and waits[1] > waits[0] * 1.4
    with pytest.raises(paged.Retryable):
        paged.with_retry(lambda: (_ for _ in ()).throw(paged.Retryable()), sleep=lambda s: None)


def test_data_source(spark, monkeypatch):
    import os

    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "fake_api.py"))
    got = paged.read_pages(spark, "fake_api", "fetch")
    assert got.count() == 250 and json.loads(got.where("ord = 7").first()["value"])["title"] == "m7"
    by_id = paged.read_pages(spark, "fake_api", "one", ids=[5, 3, 9], batch=2)
    assert sorted(r["id"] for r in by_id.select("id").collect()) == ["3", "5", "9"]


def test_json_records(spark, tmp_path):
    for name, value in {"a": [{"x": "1"}, {"x": "2"}], "b": {"contracts": [{"x": "3"}]}, "c": {"other": 1}, "d": [{"x": "4"}, 5]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = paged.json_records(spark, str(tmp_path))
    assert sorted(r["record"]["x"] for r in got.where("error is null").collect()) == ["1", "2", "3"]
    assert sorted(r["error"] for r in got.where("error is not null").collect()) == ["all records must be objects", "no array of records"]


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.unionByName(src.limit(40)).write.parquet(str(tmp_path / "events"))
    stream = streams.read_events(spark, str(tmp_path / "events"))
    assert drain(streams.first_in_window(stream, late="3650 days"), "once").count() == src.count()
    batch = streams.counts(src.withColumn("ts", src["ts"].cast("timestamp")), "1 hour")
    src.write.parquet(str(tmp_path / "plain"))
    closed = drain(streams.counts(streams.read_events(spark, str(tmp_path / "plain")), "1 hour"), "hours")
    assert closed.count() > 0 and not set(rows(closed, "started", "event_type", "n")) - set(rows(batch, "started", "event_type", "n"))


def test_unanswered_and_emit(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events"))
    events = streams.read_events(spark, str(tmp_path / "events"))
    left = streams.unanswered(events.where("event_type = 'view'"), events.where("event_type = 'click'"))
    assert left.isStreaming and "_ts" not in left.columns
    seen = []
    streams.emit(events.select("event_id"), lambda batch, i: seen.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
