"""Files with given names and their manifest; frames of video files with conditions and sampling that reach the bytes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan

from tagloom.functions import images
from tagloom.schema import TAG_COLUMNS
from tagloom.sources import named, tables, video

W, H, N, FPS = 7, 5, 40, 4


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(3)
    return {f"v{i}.y4m": rng.integers(0, 256, (N - i, H, W), dtype=np.uint8) for i in range(3)}


@pytest.fixture(scope="module")
def folder(spark, pictures, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('videos')}"
    rows = [(n, k, bytes(p.tobytes())) for n, x in pictures.items() for k, p in enumerate(x)]
    df = spark.createDataFrame(rows, "filename string, k long, luma binary").repartition(5)
    named.write_named(video.video_files(df, W, H, FPS, F.col("k"), F.col("luma")), root)
    return root


def test_manifest_lists_what_is_there(spark, pictures, folder):
    got = {r.path: (r.rows, r.bytes) for r in named.read_manifest(spark, folder).collect()}
    head = len(f"YUV4MPEG2 W{W} H{H} F{FPS}:1 Ip A1:1 Cmono\n")
    assert got == {n: (len(x) + 1, head + len(x) * (6 + W * H)) for n, x in pictures.items()}
    left = sorted(os.listdir(folder.removeprefix("file://")))
    assert left == ["_manifest", "_manifest.json", "v0.y4m", "v1.y4m", "v2.y4m"]


def test_frames_come_back(spark, pictures, folder):
    rows = video.read_frames(spark, folder).collect()
    assert len(rows) == sum(map(len, pictures.values()))
    for r in rows:
        p = pictures[r.filename][r.frame_index]
        assert bytes(r.luma) == p.tobytes() and abs(r.sharpness - images.sharpness(p)) < 1e-9
        assert (r.width, r.height, r.fps, r.timestamp_ms) == (W, H, FPS, r.frame_index * 250)
    meta = {r.filename: (r.frame_count, r.duration_ms) for r in video.read_meta(spark, folder).collect()}
    assert meta == {n: (len(x), len(x) * 250) for n, x in pictures.items()}


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_conditions_and_sampling_reach_the_bytes(folder, split):
    def read(filters, **options):
        r = video.FrameReader({"path": folder, "split": split} | options)
        rest = list(r.pushFilters(filters))
        rows = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
        assert r.read_frames == len(rows)  # nothing is read and thrown away
        return rest, sorted((x["filename"], x["frame_index"]) for x in rows)

    assert read([])[1] == [(f"v{i}.y4m", k) for i in range(3) for k in range(N - i)]
    assert read([GreaterThanOrEqual(("frame_index",), 5), LessThan(("timestamp_ms",), 2001), EqualTo(("filename",), "v1.y4m")])[1] == [("v1.y4m", k) for k in (5, 6, 7, 8)]
    assert read([GreaterThan(("frame_index",), 36), In(("filename",), ("v0.y4m", "v2.y4m"))])[1] == [("v0.y4m", 37), ("v0.y4m", 38), ("v0.y4m", 39), ("v2.y4m", 37)]
    other = IsNotNull(("luma",))
    assert read([other, EqualTo(("frame_index",), -3)]) == ([other], [])
    assert read([EqualTo(("filename",), "none")])[1] == []
    assert read([], sample_fps=1.0)[1] == [(f"v{i}.y4m", k) for i in range(3) for k in range(0, N - i, 4)]


def test_conditions_through_sql(spark, folder):
    f = video.read_frames(spark, folder, sample_fps=2.0).where("timestamp_ms BETWEEN 1000 AND 2999 AND filename IN ('v0.y4m', 'v1.y4m') AND sharpness > -1")
    assert sorted((r.filename, r.frame_index) for r in f.collect()) == [(f"v{i}.y4m", k) for i in range(2) for k in (4, 6, 8, 10)]
    assert video.read_frames(spark, folder, pixels=False).where("luma IS NULL").count() == 3 * N - 3


def test_other_files_are_told(spark, tmp_path):
    (tmp_path / "x.y4m").write_bytes(b"RIFF nothing\n")
    with pytest.raises(Exception, match="no YUV4MPEG2 header"):
        video.read_frames(spark, f"file://{tmp_path}").collect()
    (tmp_path / "x.y4m").write_bytes(b"YUV4MPEG2 W2 H1 F25:1 Cmono\nFRAME Ip\nab")
    with pytest.raises(Exception, match="has parameters"):
        video.read_frames(spark, f"file://{tmp_path}").collect()
    assert video.header_of(b"YUV4MPEG2 W4 H2 F30000:1001 C420jpeg\n").frame == 12
    assert video.header_of(b"YUV4MPEG2 W4 H2 F25:1 C444\n").frame == 24


def test_a_failed_job_leaves_no_manifest_and_no_files(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")], "path string, at long, content string")
    bad = rows.withColumn("content", F.when(F.col("path") == "c", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        named.write_named(bad, root)
    found = [f for _, _, fs in os.walk(f"{tmp_path}/out") for f in fs]
    assert not {"a", "b", "c", "_manifest.json"} & set(found)
    named.write_named(rows.where("false"), root)
    assert json.load(open(f"{tmp_path}/out/_manifest.json")) == {"files": 0, "bytes": 0, "parts": []}
    assert named.read_manifest(spark, root).collect() == []


def test_labels_tables_and_documents(spark, tmp_path):
    labels = spark.createDataFrame([("train", "v/1:5", 2, "0 b"), ("train", "v/1:5", 1, "0 a"), ("val", "w_7", 1, None)], "split string, frame string, ord long, line string")
    named.write_named(named.label_files(labels), f"file://{tmp_path}/l")
    assert (tmp_path / "l/labels/train/v_1_5.txt").read_text() == "0 a\n0 b\n"
    assert (tmp_path / "l/labels/val/w_7.txt").read_text() == ""
    row = {c: "" for c in TAG_COLUMNS}
    rows = spark.createDataFrame([row | {"filename": "a.mp4", "product_name": 'Сыр "Х", 5%\nx', "ord": i} for i in (2, 1)] + [row | {"filename": "b.mp4", "ord": 1}])
    named.write_named(named.table_files(rows, F.concat("filename", F.lit(".csv")), "ord", list(TAG_COLUMNS)), f"file://{tmp_path}/t")
    assert (tmp_path / "t/a.mp4.csv").read_bytes().startswith(b"\xef\xbb\xbf" + TAG_COLUMNS[0].encode())
    back = tables.read_rows(spark, f"file://{tmp_path}/t/*.csv").collect()
    assert sorted((r.filename, r.product_name) for r in back) == [("a.mp4", 'Сыр "Х", 5% x'), ("a.mp4", 'Сыр "Х", 5% x'), ("b.mp4", "")]
    named.write_named(named.document_files(rows.select("filename", "ord"), F.concat("filename", F.lit(".json")), "ord"), f"file://{tmp_path}/d")
    assert [json.loads(x)["ord"] for x in (tmp_path / "d/a.mp4.json").read_text().splitlines()] == [1, 2]
