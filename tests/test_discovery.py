"""The discovery stream: several sinks, replayed batches, restarts."""

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from eventloom.operators import discovery
from eventloom.plans import discovery_queries
from eventloom.streaming import discovery as stream
from tests.conftest import SF

T0 = dt.datetime(2024, 1, 15, 18)
RUNS = "run_id string, started_at timestamp, lat double, lng double, miles double"
PAGES = "source_url string, http_status int, ranged_status int, html string"


def event(url, **more):
    own = {"title": "Open Mic", "venue_name": "Hall", "address": "1 Main St", "lat": 26.0, "lng": -80.0, "start_iso": "2024-01-16T20:00:00Z", "category": "music", "tags": [], "is_free": True, "source_url": url, "description": "Music."}
    return json.dumps(own | more)


def test_gates_metrics_and_what_came_before(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [
        ("a", 1, at(1), "emit_event", event("https://x.com/early")),
        ("a", 2, at(2), "web_search", "see https://X.com:443/list and y.com:8080"),
        ("a", 3, at(3), "emit_event", event("https://x.com/ok")),
        ("a", 4, at(3), "emit_event", event("https://y.com:8080/port")),
        ("a", 5, at(3), "emit_event", event("https://x.com/far", lat=40.0)),
        ("a", 6, at(3), "emit_event", event("https://x.com/gone")),
        ("a", 7, at(3), "emit_event", event("https://x.com/other")),
        ("a", 8, at(3), "emit_event", "not json"),
        ("a", 9, at(4), "usage", json.dumps({"input_tokens": 30_000, "output_tokens": 2_500})),
        ("a", 10, at(4), "error", "boom"),
        ("a", 11, at(91), "emit_event", event("https://x.com/late")),
        ("b", 1, at(5), "emit_event", event("https://x.com/ok")),  # another run's search does not count
        ("b", 2, None, None, None),
        (None, 3, at(1), "emit_event", event("https://x.com/ok")),
        ("unknown", 4, at(1), "web_search", "x.com"),
    ]
    runs = spark.createDataFrame([("a", T0, 26.0, -80.0, 5.0), ("b", T0, 26.0, -80.0, 5.0)], RUNS)
    page = "<p>Open Mic at the Hall on 2024-01-16</p>"
    urls = {"early": (200, page), "ok": (200, page), "port": (405, page), "far": (200, page), "gone": (404, page), "other": (200, "<p>Closed</p>")}
    pages = spark.createDataFrame([(f"https://{'y.com:8080' if u == 'port' else 'x.com'}/{u}", s, 206, h) for u, (s, h) in urls.items()], PAGES)
    found = discovery.discover(spark.createDataFrame(rows, discovery.FRAMES), runs, pages)
    assert sorted((r["run_id"], r["pos"], r["source"], r["title"]) for r in found.accepted.collect()) == [("a", 3, "claude", "Open Mic"), ("a", 4, "claude", "Open Mic")]
    assert {(r["run_id"], r["pos"]): r["reason"] for r in found.rejected.collect()} == {("a", 1): "grounding", ("a", 5): "geo", ("a", 6): "head", ("a", 7): "content", ("a", 8): "schema", ("b", 1): "grounding"}
    sums = {r["run_id"]: r for r in discovery.run_metrics(found.metrics).collect()}
    assert (sums["a"]["events_emitted"], sums["a"]["events_persisted"], sums["a"]["events_rejected"], sums["a"]["web_searches"], sums["a"]["errors"]) == (7, 2, 5, 1, 1)
    assert sums["a"]["cost_usd"] == pytest.approx(0.1375) and sums["b"]["events_emitted"] == 1


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_with_a_restart_and_a_replay_equals_batch(spark, tmp_path):
    frames, runs, fetched = discovery_queries._tables(spark, SF)
    frames, runs, fetched = frames.filter("pos >= 600").persist(), runs.persist(), fetched.persist()
    whole = discovery.discover(frames, runs, fetched)
    source, path = tmp_path / "in", str(tmp_path / "out")
    cut = lambda k: frames.filter(F.floor(F.col("pos") / 37) % 4 == k)  # runs are cut across batches

    def run():
        own = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/b=*")
        query = stream.start(own, runs, fetched, path, availableNow=True)
        assert query.awaitTermination(240)

    for k in (0, 1):
        cut(k).coalesce(1).write.parquet(f"{source}/b={k}")
    run()
    assert rows(stream.read(spark, path, "accepted")) != rows(whole.accepted)
    # As if the driver was lost after the last batch's first sink: its commits are gone, half of its folders are there.
    checkpoint = tmp_path / "out" / "_checkpoint"
    for name in ("commits/1", "commits/.1.crc"):
        (checkpoint / name).unlink(missing_ok=True)
    for own in (tmp_path / "out" / "_batches").iterdir():
        if own.name.startswith("1.") or own.name.startswith(".1."):
            own.unlink()
    shutil.rmtree(tmp_path / "out" / "metrics" / "batch-1")
    for k in (2, 3):
        cut(k).coalesce(1).write.parquet(f"{source}/b={k}")
    run()
    # Events meet only searches of the same or earlier batches, so frames must come in order for equality.
    ordered = str(tmp_path / "ordered")
    for k in range(4):
        frames.filter((F.col("pos") >= 600 + 107 * k) & (F.col("pos") < 600 + 107 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/ordered_in/b={k}")
    own = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ordered_in/b=*")
    assert stream.start(own, runs, fetched, ordered, availableNow=True).awaitTermination(240)
    for sink, df in (("accepted", whole.accepted), ("rejected", whole.rejected), ("metrics", discovery.run_metrics(whole.metrics))):
        assert rows(stream.read(spark, ordered, sink)) == rows(df)
    # Every frame was judged once, replay or not.
    judged = rows(stream.read(spark, path, "accepted").select("run_id", "pos").union(stream.read(spark, path, "rejected").select("run_id", "pos")))
    assert judged == rows(whole.accepted.select("run_id", "pos").union(whole.rejected.select("run_id", "pos")))
    before = rows(stream.read(spark, ordered, "rejected"))
    stream.write_batch(frames.filter("pos >= 921"), 3, runs, fetched, ordered)  # again, by hand
    assert rows(stream.read(spark, ordered, "rejected")) == before


@pytest.mark.parametrize("name", sorted(discovery_queries.QUERIES))
def test_empty(spark, name):
    frames, runs, fetched = discovery_queries._tables(spark, SF)
    found = discovery.discover(frames.limit(0), runs, fetched)
    assert not found.accepted.count() and not found.rejected.count() and not found.metrics.count()
