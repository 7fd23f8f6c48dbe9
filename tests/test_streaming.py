"""The tracker over a stream: as the batch after restarts, in any order within the delay, closed by age and by timer."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tagloom.operators import tracking
from tagloom.plans import fixtures as fx
from tagloom.plans import media
from tagloom.streaming import tracker as st

SF = "/root/testdata/sf0.001"
EPOCH = 1704067200000
SCHEMA = "filename string, frame_index long, time timestamp, detections array<struct<ord:long,score:double,x_min:double,y_min:double,x_max:double,y_max:double,barcode:string>>"


def assigned(rows):
    return {(r.filename, r.frame_index, r.ord, r.track_id) for r in rows.where("kind = 'seen'").collect()}


def closed(rows):
    return sorted((r.filename, r.track_id, r.first_ts, r.last_ts, r.observations) for r in rows.where("kind = 'closed'").collect())


def batch(spark):
    o = fx.obs(spark, SF)
    frames = media.timed_frames(spark, SF).select("filename", "frame_index")
    rows = tracking.track(frames, o).join(o.select("ord", "frame_index"), "ord").toPandas()
    rows["ts"] = rows.frame_index * 500 + EPOCH
    tracks = rows.groupby(["filename", "track_id"]).ts.agg(["min", "max", "count"]).reset_index()
    return {(r.filename, r.frame_index, r.ord, r.track_id) for r in rows.itertuples()}, sorted(map(tuple, tracks.itertuples(index=False)))


@pytest.mark.parametrize("config", [tracking.TrackerConfig()])
def test_replay_with_restarts_is_as_the_batch(spark, tmp_path, config):
    rows = st.replayed(media.timed_frames(spark, SF), f"file://{tmp_path}/s", 3, config)
    want, tracks = batch(spark)
    assert assigned(rows) == want
    assert closed(rows) == tracks


def at(k):
    return datetime.fromtimestamp(EPOCH / 1000 + k, timezone.utc)


def frame(video, k, *dets):
    return (video, k, at(k), [(o, 0.9, x, 0.0, x + 100.0, 100.0, code) for o, x, code in dets])


def play(spark, path, *batches, config=tracking.TrackerConfig(max_lost=1), late="3 seconds", idle_ms=20_000):  # noqa: B008
    """Each batch is a run of its own from the checkpoint; None rows move the watermark only."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in/*")
        st.run_stream(st.track_stream(stream, config, late, idle_ms), path)
    return spark.read.schema(st.OUTPUT).parquet(f"{path}/rows")


def beat(k):
    return (None, None, at(k), None)


def test_order_within_the_delay_doesnt_matter(spark, tmp_path):
    rows = play(spark, f"file://{tmp_path}/s", [frame("a", 2, (2, 4.0, None)), frame("a", 1, (1, 0.0, None))], [frame("a", 4, (4, 12.0, None)), frame("a", 3, (3, 8.0, None))], [beat(100)])
    assert assigned(rows) == {("a", i, i, 1) for i in range(1, 5)}
    assert closed(rows) == [("a", 1, EPOCH + 1000, EPOCH + 4000, 4)]


def test_tracks_close_by_age_and_by_timer_and_videos_begin_anew(spark, tmp_path):
    far = 5000.0
    first = [frame("a", 1, (1, 0.0, None), (2, far, None)), frame("a", 2, (3, 1.0, None)), frame("a", 3), frame("a", 4, (4, 2.0, None)), frame("b", 1)]
    rows = play(spark, f"file://{tmp_path}/s", first, [beat(10)], [beat(12)], [beat(60)], [frame("a", 70, (5, 0.0, None))], [beat(200)])
    assert assigned(rows) == {("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 2, 3, 1), ("a", 4, 4, 1), ("a", 70, 5, 1)}
    s = 1000
    # track 2 by age (two frames without it), 1 by the timer; the video that came back after its state was freed counts from 1
    assert closed(rows) == [("a", 1, EPOCH + s, EPOCH + 4 * s, 3), ("a", 1, EPOCH + 70 * s, EPOCH + 70 * s, 1), ("a", 2, EPOCH + s, EPOCH + s, 1)]


def test_late_frames_are_dropped_and_identifiers_kept(spark, tmp_path):
    rows = play(spark, f"file://{tmp_path}/s", [frame("a", 1, (1, 0.0, "46")), frame("a", 30)], [frame("a", 2, (2, 0.0, "46")), frame("a", 31, (3, 0.0, "46"))], [frame("a", 32, (4, 0.0, "47"))], [beat(300)], config=tracking.TrackerConfig(), idle_ms=60_000)
    assert assigned(rows) == {("a", 1, 1, 1), ("a", 31, 3, 1), ("a", 32, 4, 2)}
    assert [(x[1], x[4]) for x in closed(rows)] == [(1, 2), (2, 1)]


def test_empty_table(spark, tmp_path):
    assert st.replayed(media.timed_frames(spark, SF).where("false"), f"file://{tmp_path}/s").collect() == []


def test_heartbeats_have_no_rows(spark):
    assert spark.createDataFrame([beat(1)], SCHEMA).where(F.col("filename").isNull()).count() == 1


def test_one_frame_is_held_at_a_time():
    """Waiting detections are fetched, and told, frame by frame, in order of frames and ordinals; pieces of one frame together."""
    import pandas as pd

    from tagloom.streaming.tracker import IDS, SIDES, TrackVideos

    class State:
        def __init__(self):
            self.held, self.log = {}, []

        exists = lambda self: bool(self.held)
        get = lambda self: self.held[()]
        keys = lambda self: iter(list(self.held))
        iterator = lambda self: iter(list(self.held.items()))
        clear = lambda self: self.held.clear()
        update = lambda self, v: self.held.update({(): v})
        updateValue = lambda self, k, v: self.held.update({k: v})

        def getValue(self, k):
            self.log.append(k[0])
            return self.held[k]

        def removeKey(self, k):
            del self.held[k]

    class Handle:
        getValueState = getMapState = lambda self, *_: State()
        registerTimer = deleteTimer = lambda self, _: None

    row = lambda f, o: {"frame_index": f, "ts": f * 500, "ord": o, "score": 0.5, **dict(zip(SIDES, (o % 10 * 300.0, 0.0, o % 10 * 300.0 + 90, 50.0), strict=True)), **dict.fromkeys(IDS)}
    rows = [row(f, f * 10 + i) for i in (3, 1, 2, 0) for f in (2, 0, 3, 1)] + [row(4, 0) | {"ord": None, "score": None}]
    p = TrackVideos(tracking.TrackerConfig(), 60_000)
    p.init(Handle())
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 1800})()
    seen = []
    for out in p.handleInputRows(("v",), iter([pd.DataFrame(rows[at : at + 7]) for at in range(0, len(rows), 7)]), clock):
        if len(out):
            assert set(out.frame_index) == {p.waiting.log[-1]}
            seen += list(zip(out.frame_index, out.ord, out.track_id, strict=True))
    assert seen == [(f, f * 10 + i, i + 1) for f in range(4) for i in range(4)]
    assert {k[0] for k in p.waiting.held} == {4} and p.waiting.log == sorted(p.waiting.log)
