"""The run as a command: frames and observations to a table for each video.

    spark-submit --py-files ... -m tagloom FRAMES OBSERVATIONS --output-dir DIR [options]

FRAMES and OBSERVATIONS are tables (Parquet): filename, frame_index, timestamp_ms, sharpness; and filename, frame_index,
ord, timestamp_ms, sides, score, source and what was read in the box (text, payloads, quality, visual_hash, fields).
Written are `<video>_recognized.csv` and, if asked, `<video>_debug.jsonl` for each video, and a manifest last.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import runs, tracking
from .schema import TAG_COLUMNS
from .sources import named, tables
from .sources.shared import checkpoints

# What --fast sets at most, and the run's defaults.
FAST_FPS, FAST_DETECTIONS = 1.0, 30
DEFAULTS = {"fps": 20.0, "sample_fps": 2.0, "min_sharpness": 18.0, "max_frames": 0, "max_detections_per_frame": 80, "tracker_iou": 0.12, "tracker_center_threshold": 250.0, "max_lost": 5, "representative_temporal_weight": 0.0, "fallback_require_evidence": True, "min_track_observations": 1, "save_debug_json": True}


def settings(args: argparse.Namespace) -> dict:
    """Defaults, then the file's, then the command line's."""
    c = DEFAULTS | {k: v for k, v in tables.read_config(args.config).items() if k in DEFAULTS}
    c |= {k: v for k, v in (("sample_fps", args.sample_fps), ("max_frames", args.max_frames), ("fps", args.fps)) if v is not None}
    if args.fast:
        c |= {"sample_fps": min(float(c["sample_fps"]), FAST_FPS), "max_detections_per_frame": min(int(c["max_detections_per_frame"]), FAST_DETECTIONS)}
    return c


def process(frames: DataFrame, obs: DataFrame, c: dict, output_dir: str, output_csv: str | None = None) -> int:
    """Run and write; the number of rows."""
    spark = frames.sparkSession
    checkpoints(spark)
    sampled = tables.sample_frames(frames, F.lit(float(c["fps"])), float(c["sample_fps"]), float(c["min_sharpness"]), int(c["max_frames"] or 0)).checkpoint()
    best = Window.partitionBy("filename", "frame_index").orderBy(F.desc("score"), "ord")
    kept = obs.join(sampled.select("filename", "frame_index"), ["filename", "frame_index"], "left_semi")
    kept = kept.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= int(c["max_detections_per_frame"])).drop("__r")
    config = tracking.TrackerConfig(float(c["tracker_iou"]), float(c["tracker_center_threshold"]), int(c["max_lost"]))
    tracks = runs.tracked(sampled, kept, config).checkpoint()
    rows = runs.finished(tracks, int(c["min_track_observations"]), float(c["representative_temporal_weight"]), tables.env_flag({"x": str(c["fallback_require_evidence"])}, "x", True)).checkpoint()
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    if output_csv:
        tables.write_rows(rows, output_csv)
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("filename").orderBy(F.coalesce("frame_timestamp", F.lit(0)), F.coalesce("y_min", F.lit(0.0)), F.coalesce("x_min", F.lit(0.0)))))
    files = named.table_files(numbered, F.concat(stem, F.lit("_recognized.csv")), "at", list(TAG_COLUMNS))
    if tables.env_flag({"x": str(c["save_debug_json"])}, "x", True):
        files = files.unionByName(debug_lines(sampled, tracks, rows, c, F.concat(stem, F.lit("_debug.jsonl"))))
    named.write_named(files, output_dir)
    return rows.count()


def debug_lines(frames: DataFrame, tracks: DataFrame, rows: DataFrame, c: dict, name) -> DataFrame:
    """Rows for write_named: a line with the settings and sums of each video, one for each frame, one for each track with its path."""
    seen = tracks.groupBy("filename", "frame_index").agg(F.count("*").alias("observations"))
    each = frames.join(seen, ["filename", "frame_index"], "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    total = each.groupBy("filename").agg(F.count("*").alias("frames"), F.sum("observations").alias("total_observations")).join(rows.groupBy("filename").agg(F.count("*").alias("rows")), "filename", "left")
    head = total.select(name.alias("path"), F.lit(-1).cast("long").alias("at"), F.struct("filename", "frames", "total_observations", F.coalesce("rows", F.lit(0)).alias("rows"), *(F.lit(v).alias(k) for k, v in sorted(c.items()))).alias("x"))
    middle = each.select(name.alias("path"), F.col("frame_index").alias("at"), F.struct("frame_index", "timestamp_ms", "sharpness", "observations").alias("x"))
    path = F.array_sort(F.collect_list(F.struct("timestamp_ms", "ord", "x_min", "y_min", "x_max", "y_max", "score", "source")))  # of one track
    tail = tracks.groupBy("filename", "track_id").agg(path.alias("path_"), F.min("timestamp_ms").alias("first_ts"), F.max("timestamp_ms").alias("last_ts"))
    tail = tail.select(name.alias("path"), (F.col("track_id") + (1 << 61)).alias("at"), F.struct("track_id", "first_ts", "last_ts", F.col("path_").alias("observations")).alias("x"))
    lines = [df.select("path", F.col("at").cast("long").alias("at"), F.concat(F.to_json("x"), F.lit("\n")).alias("content")) for df in (head, middle, tail)]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tagloom", description="From frames and observations to one record a price tag")
    p.add_argument("frames")
    p.add_argument("observations")
    p.add_argument("--config", help="settings, JSON or YAML")
    p.add_argument("--output-dir", required=True, help="folder (URI) of the files by video")
    p.add_argument("--output-csv", help="folder of one table of all videos")
    p.add_argument("--fps", type=float)
    p.add_argument("--sample-fps", type=float)
    p.add_argument("--max-frames", type=int)
    p.add_argument("--fast", action="store_true", help="one frame a second at most, 30 detections a frame at most")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tagloom").getOrCreate()
    n = process(spark.read.parquet(args.frames), spark.read.parquet(args.observations), settings(args), args.output_dir, args.output_csv)
    print(f"rows={n}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
