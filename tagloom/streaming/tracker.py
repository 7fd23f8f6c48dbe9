"""The tracker over a stream: state per video, frames in order of time, tracks closed by age or by the clock of events.

A frame is a row with an array of detections, so empty frames are rows too and age the tracks. Frames wait in a map
until the watermark has passed them and are then taken in order, so batches may bring them in any order within the
watermark's delay; later ones are dropped by Spark. A track is closed, and told, when too many frames went by without
it; when no frame of a video came for `idle_ms` of event time, a timer closes its other tracks and frees its state.

Rows of `heartbeat` videos (null filename) have no frame; their time only moves the watermark, as the end of a file does.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import ID_GROUPS, Track, Tracker, TrackerConfig, identifiers

SIDES = ("x_min", "y_min", "x_max", "y_max")
IDS = tuple(c for group in ID_GROUPS for c in group)
#: A row for each detection (ord, frame_index), and one for each closed track (first_ts, last_ts, observations).
OUTPUT = "filename string, kind string, track_id long, frame_index long, ord long, first_ts long, last_ts long, observations long"
DETECTION = f"array<struct<ord:long,score:double,{','.join(f'{c}:double' for c in SIDES)},{','.join(f'{c}:string' for c in IDS)}>>"
_BOX = ", ".join(f"{c} double" for c in SIDES)
#: State. head: what the next frame needs; tracks: live ones by number; waiting: detections of frames to come, in pieces as they came, none for an empty frame.
HEAD, TRACK_KEY, TRACK = "last_frame long, next_id long, last_ts long, timer long, pieces long", "track_id long", f"{_BOX}, lost int, ids array<array<string>>, first_ts long, last_ts long, observations long"
PIECE_KEY, PIECE = "frame_index long, ts long, piece long", "ord array<long>, score array<double>, box array<array<double>>, ids array<array<array<string>>>"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class TrackVideos(StatefulProcessor):
    """Tracker.step() behind list, map and value state and event-time timers."""

    def __init__(self, config: TrackerConfig, idle_ms: int):
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.tracks = handle.getMapState("tracks", TRACK_KEY, TRACK)
        self.waiting = handle.getMapState("waiting", PIECE_KEY, PIECE)

    def handleInputRows(self, key, rows, timerValues):
        last_frame, next_id, last_ts, timer, pieces = self.head.get() if self.head.exists() else (-1, 1, None, None, 0)
        for batch in rows:
            for (frame, ts), part in batch.groupby(["frame_index", "ts"], sort=False):
                part = part[part.ord.notna()]
                none = [[[], [], []]] * len(part) if part[list(IDS)].isna().all(axis=None) else [identifiers(r) for r in part[list(IDS)].to_dict("records")]
                self.waiting.updateValue((int(frame), int(ts), pieces), (part.ord.astype("int64").tolist(), part.score.astype(float).tolist(), part[list(SIDES)].astype(float).to_numpy().tolist(), none))
                pieces += 1
        yield from self.advance(key[0], timerValues.getCurrentWatermarkInMs(), last_frame, next_id, last_ts, timer, pieces)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.advance(key[0], timerValues.getCurrentWatermarkInMs(), *(self.head.get() if self.head.exists() else (-1, 1, None, None, 0)))

    def advance(self, name: str, watermark: int, last_frame: int, next_id: int, last_ts: int | None, timer: int | None, pieces: int) -> Iterator[pd.DataFrame]:
        """Take all waiting frames that the watermark has passed, one at a time; set the timer for the next, or for the video's end."""
        keys = [tuple(k) for k in self.waiting.keys()] if self.waiting.exists() else []
        ready, later = sorted(k for k in keys if k[1] < watermark), [k for k in keys if k[1] >= watermark]
        if ready:
            last_frame, next_id, last_ts = yield from self.steps(name, ready, last_frame, next_id, last_ts)
        if last_ts is not None and not later and last_ts + self.idle_ms < watermark:
            yield self.told([self.closed(name, k[0], t) for k, t in self.tracks.iterator()])
            for state in (self.head, self.tracks, self.waiting):
                state.clear()
            self.move_timer(timer, None)
        else:
            due = min(k[1] for k in later) if later else last_ts + self.idle_ms
            due = max(due, watermark) + 1
            self.head.update((last_frame, next_id, last_ts, self.move_timer(timer, due), pieces))

    def told(self, out: list[tuple]) -> pd.DataFrame:
        kinds = {c.split()[0]: "Int64" for c in OUTPUT.split(", ")[2:]}
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype(kinds)

    def move_timer(self, old: int | None, new: int | None) -> int | None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new

    def steps(self, name: str, ready: list[tuple], last_frame: int, next_id: int, last_ts: int | None) -> Generator[pd.DataFrame, None, tuple[int, int, int]]:
        """Assign the detections of ready frames (keys of pieces, in order), of which one is held at a time; a frame that was taken before is skipped."""
        held = {k[0]: tuple(t) for k, t in self.tracks.iterator()}
        life = {k: t[6:9] for k, t in held.items()}
        tracker = Tracker(self.config, [Track(k, t[:4], t[4], [list(x) for x in t[5]]) for k, t in held.items()], next_id)
        for frame, parts in itertools.groupby(ready, key=lambda k: k[0]):
            rows = []
            for k in parts:
                ords, scores, boxes, ids = self.waiting.getValue(k)
                rows += [(o, k[1], s, tuple(b), [list(x) for x in i]) for o, s, b, i in zip(ords, scores, boxes, ids, strict=True)] or [(None, k[1])]
                self.waiting.removeKey(k)
            if frame > last_frame:
                rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
                ts, dets = rows[0][1], {r[0]: (r[2], r[0], r[3], r[4]) for r in rows if r[0] is not None}
                out, before = [], dict(tracker.tracks)
                for ord_, k in sorted(tracker.step(list(dets.values())).items()):
                    first, _, n = life.get(k, (ts, ts, 0))
                    life[k] = (first, ts, n + 1)
                    out.append((name, "seen", k, frame, ord_, None, None, None))
                out += [(name, "closed", k, None, None, *life.pop(k)) for k in before if k not in tracker.tracks]
                last_frame, last_ts = frame, ts if last_ts is None else max(ts, last_ts)
                yield self.told(out)
        out = []
        out += [(name, "closed", k, None, None, *life.pop(k)) for k, t in tracker.tracks.items() if t.lost > self.config.max_lost]
        alive = {k: t for k, t in tracker.tracks.items() if t.lost <= self.config.max_lost}
        for k in held.keys() - alive.keys():
            self.tracks.removeKey((k,))
        for k, t in alive.items():
            new = (*map(float, t.box), int(t.lost), [list(x) for x in t.ids], *map(int, life[k]))
            if held.get(k) != new:
                self.tracks.updateValue((k,), new)
        yield self.told(out)
        return last_frame, tracker.next_id, last_ts

    def closed(self, name: str, k: int, t: tuple) -> tuple:
        return (name, "closed", int(k), None, None, *map(int, t[6:9]))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that such state needs, while a query is started."""
    before = {k: spark.conf.get(k) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def track_stream(frames: DataFrame, config: TrackerConfig = TrackerConfig(), late: str = "30 seconds", idle_ms: int = 60_000) -> DataFrame:  # noqa: B008
    """frames: filename, frame_index, time (timestamp) and detections (array of ord, score, box sides and identifiers, if any).

    Rows of OUTPUT. Start the query within state_store().
    """
    has = {f.name for f in frames.schema["detections"].dataType.elementType.fields}
    whole = F.transform("detections", lambda d: F.struct(*((d[c] if c in has else F.lit(None)).alias(c) for c in ("ord", "score", *SIDES, *IDS)))).cast(DETECTION)
    # the condition names the time, so that it isn't moved below the watermark, which heartbeats must reach
    timed = frames.where("time IS NOT NULL").withWatermark("time", late).where("filename IS NOT NULL OR time IS NULL").select("filename", "frame_index", F.unix_millis("time").alias("ts"), F.explode_outer(whole).alias("d"), "time").select("filename", "frame_index", "ts", "d.*", "time")  # a row for each detection: batches are of so many rows
    return timed.groupBy("filename").transformWithStateInPandas(TrackVideos(config, idle_ms), OUTPUT, "append", "eventTime")


def run_stream(stream: DataFrame, path: str) -> None:
    """Write a stream's rows so far to Parquet below `path`, going on from the checkpoint there."""
    with state_store(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def replayed(frames: DataFrame, path: str, slices: int = 3, config: TrackerConfig = TrackerConfig(), late: str = "1 second", idle_ms: int = 60_000) -> DataFrame:  # noqa: B008
    """track_stream over a table of frames that arrives in slices of time below `path`; every slice restarts the query from its checkpoint.

    A heartbeat behind the last slice closes all videos.
    """
    spark = frames.sparkSession
    first, last = frames.agg(F.min("time"), F.max("time")).first()
    if first is None:
        return spark.createDataFrame([], OUTPUT)
    width = F.lit((last - first) / slices)
    part = F.least(F.floor((F.unix_micros("time") - F.unix_micros(F.lit(first))) / F.greatest(F.unix_micros(F.lit(first) + width) - F.unix_micros(F.lit(first)), F.lit(1))), F.lit(slices - 1))
    placed = frames.withColumn("part", part)
    stream = spark.readStream.schema(frames.schema).parquet(f"{path}/in/*")
    for i in range(slices):
        now = placed.where(F.col("part") == i).drop("part")
        if i == slices - 1:
            beat = {"time": F.lit(last) + F.expr(f"make_dt_interval(0, 0, 0, {idle_ms / 1000 + 3600})")}
            now = now.unionByName(spark.range(1).select(*(beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in frames.schema)))
        now.write.parquet(f"{path}/in/{i}")
        run_stream(track_stream(stream, config, late, idle_ms), path)
    return spark.read.schema(OUTPUT).parquet(f"{path}/rows")


def windowed_counts(frames: DataFrame, time: str = "time", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Frames and detections of each video in windows of time; the watermark bounds the state."""
    return frames.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "filename").agg(F.count("*").alias("frames"), F.sum(F.size("detections")).alias("detections")).select(F.col("w.start").alias("start"), "filename", "frames", "detections")
