"""Registered queries over streams and files: what is written by the library's own sinks, and read by its own sources."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, hashes
from ..operators import ensemble, propagation
from ..schema import TAG_COLUMNS
from ..sources import named, video
from ..sources.shared import shared_folder
from ..streaming import tracker
from . import fixtures as fx
from .queries import query

#: The epoch of the derived frames' time.
EPOCH_MS = 1704067200000
WIDTH, HEIGHT, FPS = 8, 6, 2


def timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the array of their detections and their time; empty ones too, up to each video's last."""
    o = fx.obs(spark, sf_dir)
    found = o.groupBy("filename", "frame_index").agg(F.collect_list(F.struct("ord", "score", "x_min", "y_min", "x_max", "y_max")).alias("detections"))
    last = o.groupBy("filename").agg(F.max("frame_index").alias("n"))
    every = last.select("filename", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("frame_index"))
    return every.join(found, ["filename", "frame_index"], "left").withColumn("time", F.timestamp_millis(F.col("frame_index") * 500 + EPOCH_MS))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.replayed(timed_frames(spark, sf_dir), shared_folder(spark, "stream-tracks"))


@query("stream_tracks")
def stream_tracks(spark, sf_dir):
    """Tracks as the stream closes them, the table's frames arriving in three parts with a restart before each."""
    return streamed(spark, sf_dir).where("kind = 'closed'").select("filename", "track_id", "first_ts", "last_ts", "observations")


@query("stream_assignments")
def stream_assignments(spark, sf_dir):
    return streamed(spark, sf_dir).where("kind = 'seen'").select("filename", "frame_index", "ord", "track_id")


@query("windowed_frames", fx.OBS + f""", w AS (SELECT filename, frame_index, count(*) AS n FROM obs GROUP BY ALL)
SELECT filename, frame_index * 500 // 10000 * 10000 AS start_ms, count(*) AS frames, CAST(sum(n) AS BIGINT) AS detections FROM w GROUP BY ALL""")
def windowed_frames(spark, sf_dir):
    """Frames and detections in windows of ten seconds of event time."""
    t = timed_frames(spark, sf_dir).where("detections IS NOT NULL")
    w = tracker.windowed_counts(t, width="10 seconds")
    return w.select("filename", (F.unix_millis("start") - EPOCH_MS).alias("start_ms"), "frames", "detections")


# --- frames of video files

PICTURES = fx.OBS + """, pf AS (SELECT replace(filename, 'mp4', 'y4m') AS filename, row_number() OVER (PARTITION BY filename ORDER BY frame_index) - 1 AS k, sum(cents) AS c FROM obs GROUP BY filename, frame_index)"""


def written_videos(spark: SparkSession, sf_dir: str) -> str:
    """Small made-up pictures of every frame, written as a video file each; returns their folder."""
    o = fx.obs(spark, sf_dir).groupBy("filename", "frame_index").agg(F.sum("cents").alias("c"))
    o = o.select(F.regexp_replace("filename", "mp4", "y4m").alias("filename"), "c", (F.row_number().over(Window.partitionBy("filename").orderBy("frame_index")) - 1).alias("k"))
    pixel = lambda i: F.lpad(F.hex((F.col("c") + i * 7 + F.col("k") * 13) % 256), 2, "0")
    luma = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1)), pixel), ""))
    root = shared_folder(spark, "videos")
    named.write_named(video.video_files(o, WIDTH, HEIGHT, FPS, F.col("k"), luma), root)
    return root


@query("video_frames", PICTURES + """, v AS (SELECT filename, k, x.x, y.y, c, k * 13 + c AS b FROM pf, range(8) x(x), range(6) y(y) WHERE k % 2 = 0 AND k >= 10 AND k * 500 < 24000),
p AS (SELECT *, (b + (y * 8 + x) * 7) % 256 AS m, (b + (y * 8 + CASE x WHEN 0 THEN 1 ELSE x - 1 END) * 7) % 256 AS l, (b + (y * 8 + CASE x WHEN 7 THEN 6 ELSE x + 1 END) * 7) % 256 AS r,
  (b + (CASE y WHEN 0 THEN 1 ELSE y - 1 END * 8 + x) * 7) % 256 AS u, (b + (CASE y WHEN 5 THEN 4 ELSE y + 1 END * 8 + x) * 7) % 256 AS d FROM v)
SELECT filename, k AS frame_index, k * 500 AS timestamp_ms, CAST(sum(m) AS BIGINT) AS luma_sum, round(var_pop(CAST(l + r + u + d - 4 * m AS DOUBLE)), 6) AS sharpness FROM p GROUP BY filename, k""")
def video_frames(spark, sf_dir):
    """Every second frame of a range of time, read from video files: sum of its pixels and sharpness."""
    f = video.read_frames(spark, written_videos(spark, sf_dir), sample_fps=1.0).where("frame_index >= 10 AND timestamp_ms < 24000")
    pixel = lambda i: F.conv(F.hex(F.substring("luma", i + 1, F.lit(1))), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(0), F.length("luma") - 1), F.lit(0).cast("long"), lambda s, i: s + pixel(i))
    return f.select("filename", "frame_index", "timestamp_ms", total.alias("luma_sum"), F.round("sharpness", 6).alias("sharpness"))


@query("video_files", PICTURES + "SELECT filename, 8::INTEGER AS width, 6::INTEGER AS height, 2.0::DOUBLE AS fps, count(*) AS frame_count, count(*) * 500 AS duration_ms FROM pf GROUP BY filename")
def video_files(spark, sf_dir):
    return video.read_meta(spark, written_videos(spark, sf_dir))


# --- sinks with a commit

LABELS = fx.OBS + """, lb AS (SELECT ord, CASE WHEN CAST('0x' || substr(md5(filename || ':' || timestamp_ms), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split, filename || '_' || timestamp_ms AS frame,
 '0 ' || printf('%.6f', (x_min + x_max) / 2 / 4000) || ' ' || printf('%.6f', (y_min + y_max) / 2 / 2160) || ' ' || printf('%.6f', (x_max - x_min) / 4000) || ' ' || printf('%.6f', (y_max - y_min) / 2160) AS line FROM obs WHERE x_max < 3999)"""


@query("label_files", LABELS + """, fl AS (SELECT 'labels/' || split || '/' || frame || '.txt' AS path, count(*) AS rows, string_agg(line || chr(10), '' ORDER BY ord) AS content FROM lb GROUP BY split, frame)
SELECT path, rows, length(content) AS bytes, sha256(content) AS sha256 FROM fl""")
def label_files(spark, sf_dir):
    """A file of labels for each frame, in folders by split; what the manifest says of them."""
    o = fx.with_box(fx.obs(spark, sf_dir)).where("box.x_max < 3999")
    split = F.when(hashes.in_validation(F.col("filename"), F.col("timestamp_ms").cast("double"), 0.2), "val").otherwise("train")
    labels = o.select(split.alias("split"), F.concat_ws("_", "filename", "timestamp_ms").alias("frame"), "ord", geometry.yolo_line(F.col("box"), F.lit(4000.0), F.lit(2160.0)).alias("line"))
    root = shared_folder(spark, "labels")
    named.write_named(named.label_files(labels), root)
    return named.read_manifest(spark, root)


@query("result_files", fx.TRACK_ROWS + "SELECT filename, filename || '.csv' AS file, CAST(timestamp_ms AS VARCHAR) AS frame_timestamp, CASE WHEN product_name = '' THEN NULL ELSE product_name END AS product_name, CASE WHEN price_default = '' THEN NULL ELSE price_default END AS price_default, CASE WHEN barcode = '' THEN NULL ELSE barcode END AS barcode FROM tr")
def result_files(spark, sf_dir):
    """The table's rows as a CSV file for each video, read again by name."""
    rows = fx.track_rows(spark, sf_dir)
    rows = rows.select(*((F.col(c) if c in rows.columns else F.lit("")).cast("string").alias(c) for c in TAG_COLUMNS), "ord")
    root = shared_folder(spark, "results")
    named.write_named(named.table_files(rows, F.concat("filename", F.lit(".csv")), "ord", list(TAG_COLUMNS)), root)
    back = spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{root}/*.csv")
    return back.select("filename", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "frame_timestamp", "product_name", "price_default", "barcode")


@query("track_documents", fx.TRACK_ROWS + "SELECT filename || '.json' AS path, count(DISTINCT track_id) AS rows, CAST(sum(timestamp_ms) AS BIGINT) AS total_ms FROM tr GROUP BY filename")
def track_documents(spark, sf_dir):
    """A debug document for each video with the path of each of its tracks, and what reading them again adds up to."""
    tr = fx.track_rows(spark, sf_dir).groupBy("filename", "track_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "ord", "x_min", "y_min", "x_max", "y_max", "score", "source"))).alias("path"))
    root = shared_folder(spark, "debug")
    named.write_named(named.document_files(tr, F.concat("filename", F.lit(".json")), "track_id"), root)
    back = spark.read.schema("filename string, track_id long, path array<struct<timestamp_ms:long,ord:long>>").json(f"{root}/*.json")
    total = F.aggregate("path", F.lit(0).cast("long"), lambda s, x: s + x["timestamp_ms"])
    return back.groupBy(F.concat("filename", F.lit(".json")).alias("path")).agg(F.count("*").alias("rows"), F.sum(total).alias("total_ms"))


# --- detectors of which some fail


def middle_box(width: float) -> ensemble.Detector:
    """A stand-in detector: a box of this width in each frame, its place from the frame's number."""
    return lambda f: f.assign(x_min=f.frame_index % 50, y_min=0.0, x_max=f.frame_index % 50 + width, y_max=10.0, score=(f.frame_index % 10) / 10)


def broken() -> ensemble.Detector:
    raise OSError("no weights")


@query("guarded_detections", fx.OBS + """, fr AS (SELECT DISTINCT filename, frame_index FROM obs)
SELECT 'full' AS source, count(*) AS n, round(sum((frame_index % 10) / 10.0::DOUBLE), 6) AS score, 0 AS frames_lost FROM fr
UNION ALL SELECT 'zone', count(*), round(sum((frame_index % 10) / 10.0::DOUBLE * 0.97::DOUBLE), 6), 0 FROM fr UNION ALL SELECT 'broken', 0, 0.0, count(*) FROM fr""")
def guarded_detections(spark, sf_dir):
    """Sums over the detections of three detectors, one of which can't be made: the others' stand, and the frames it didn't see are told."""
    frames = fx.obs(spark, sf_dir).select("filename", "frame_index").distinct()
    found, lost = ensemble.detections(frames, {"full": lambda: middle_box(20.0), "zone": lambda: middle_box(9.0), "broken": broken}, weights={"zone": 0.97})
    sums = found.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.lit(0).cast("long").alias("frames_lost"))
    return sums.unionByName(lost.groupBy("source").agg(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"), F.sum("frames_lost").alias("frames_lost")))


# --- labels carried along


def moving_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of 64 x 48 for each frame: its video's pattern, two pixels further each frame, and some noise of its own."""

    def run(batches):
        for batch in batches:
            out = []
            for name, k, c in zip(batch.filename, batch.frame_index, batch.c, strict=True):
                pattern = np.random.default_rng(zlib.crc32(name.encode())).integers(0, 256, (48, 160))
                noise = np.random.default_rng(int(c)).integers(-20, 21, (48, 64))
                out.append(np.clip(np.roll(pattern, -2 * int(k), 1)[:, :64] + noise, 0, 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"filename": batch.filename, "frame_index": batch.frame_index, "width": 64, "height": 48, "luma": out}).astype({"width": "int32", "height": "int32"})

    o = fx.obs(spark, sf_dir).groupBy("filename", "frame_index").agg(F.sum("cents").alias("c"))
    return o.mapInPandas(run, "filename string, frame_index long, width int, height int, luma binary")


def small_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 16 x 12 for each detection in such a picture."""
    side = lambda c, n: (F.col("cents") % n + c).cast("double")
    return fx.obs(spark, sf_dir).select("filename", "frame_index", "ord", side(0, 40).alias("x_min"), side(0, 30).alias("y_min"), side(16, 40).alias("x_max"), side(12, 30).alias("y_max"))


@query("propagated_labels")
def propagated_labels(spark, sf_dir):
    """Boxes of every frame, carried to two frames before and behind it by their pixels."""
    return propagation.propagated_labels(moving_pictures(spark, sf_dir), small_labels(spark, sf_dir), 2, 12).withColumn("score", F.round("score", 6))
