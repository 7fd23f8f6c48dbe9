"""The command's run with its files, and detectors that fail."""

import csv
import json

from pyspark.sql import functions as F

from tagloom import __main__ as command
from tagloom.operators import ensemble, runs, tracking
from tagloom.plans import fixtures as fx
from tagloom.schema import TAG_COLUMNS
from tagloom.sources import named

SF = "/root/testdata/sf0.001"


def inputs(spark, path):
    o = fx.track_rows(spark, SF).drop("track_id").withColumn("visual_hash", F.lower(F.lpad(F.hex(F.col("cents") * 2654435761), 16, "0")))
    f = o.select("filename", "frame_index", "timestamp_ms", (F.col("frame_index") * 7 % 50).alias("sharpness")).distinct()
    f.write.parquet(f"{path}/frames")
    o.write.parquet(f"{path}/obs")
    return f, o


def test_command(spark, tmp_path):
    f, o = inputs(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"min_sharpness": 10, "fps": 4, "sample_fps": 2, "max_lost": 3, "unknown": 1}))
    out = f"file://{tmp_path}/out"
    assert command.main([f"{tmp_path}/frames", f"{tmp_path}/obs", "--config", f"{tmp_path}/c.json", "--output-dir", out, "--output-csv", f"file://{tmp_path}/one"]) == 0
    sampled = f.where("frame_index % 2 = 0 AND sharpness >= 10")
    want = runs.run(sampled, o.join(sampled.select("filename", "frame_index"), ["filename", "frame_index"], "left_semi"), tracking.TrackerConfig(max_lost=3)).collect()
    files = {r.path: r.rows for r in named.read_manifest(spark, out).collect()}
    got = []
    for name in {r.filename for r in want}:
        with open(f"{tmp_path}/out/{name.removesuffix('.mp4')}_recognized.csv", encoding="utf-8-sig", newline="") as x:
            rows = list(csv.DictReader(x))
        assert list(rows[0]) == list(TAG_COLUMNS) and files[f"{name.removesuffix('.mp4')}_recognized.csv"] == len(rows) + 1
        assert [int(r["frame_timestamp"]) for r in rows] == sorted(int(r["frame_timestamp"]) for r in rows)
        got += rows
    key = lambda r: (r["filename"], int(r["frame_timestamp"]), float(r["x_min"]), r["product_name"] or "", r["barcode"] or "")
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in want) and got
    with open(f"{tmp_path}/out/v1_debug.jsonl", encoding="utf-8") as x:
        lines = [json.loads(v) for v in x]
    assert lines[0]["filename"] == "v1.mp4" and lines[0]["max_lost"] == 3 and lines[0]["rows"] == sum(r.filename == "v1.mp4" for r in want)
    assert sum("sharpness" in v for v in lines[1:]) == lines[0]["frames"]
    assert sum(len(v["observations"]) for v in lines[1:] if "track_id" in v) == lines[0]["total_observations"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/one").count() == len(want)


def test_options():
    parse = lambda *a: command.settings(__import__("argparse").Namespace(**({"config": None, "sample_fps": None, "max_frames": None, "fps": None, "fast": False} | dict(a))))
    assert parse()["sample_fps"] == 2.0
    assert parse(("fast", True))["sample_fps"] == 1.0 and parse(("fast", True))["max_detections_per_frame"] == 30
    assert parse(("fast", True), ("sample_fps", 0.5))["sample_fps"] == 0.5
    assert parse(("max_frames", 7))["max_frames"] == 7


def test_failing_detectors_dont_stop_the_others(spark):
    frames = spark.createDataFrame([("v", i) for i in range(60)], "filename string, frame_index long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        box = lambda f: f.assign(x_min=0.0, y_min=0.0, x_max=1.0, y_max=1.0, score=0.5)

        def sometimes():
            def detect(f):
                if f.frame_index.iloc[0] in (10, 30, 40):
                    raise ValueError("blurred")
                return box(f)

            return detect

        def never():
            raise OSError("no weights")

        found, lost = ensemble.detections(frames, {"good": lambda: box, "some": sometimes, "none": never}, weights={"good": 0.5})
        counts = {(r.source, r.score): r["count"] for r in found.groupBy("source", "score").count().collect()}
        errors = [(r.source, r.frame_index, r.frames_lost, r.error) for r in lost.orderBy("source", "frame_index").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert counts == {("good", 0.25): 60, ("some", 0.5): 20}
    assert [e[:3] for e in errors if e[0] == "some"] == [("some", 10, 10), ("some", 30, 10), ("some", 40, 10), ("some", 50, 10)]
    assert errors[-1][3] == "not asked after 3 failures: ValueError: blurred"
    assert [e[3] for e in errors if e[0] == "none"] == ["OSError: no weights"] * 3 + ["not asked after 3 failures: OSError: no weights"] * 3
    assert ensemble.detections(frames, {})[0].collect() == []
