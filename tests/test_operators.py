"""Operators against plain Python, and the examples that fix their behaviour."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagloom.functions import fields, geometry, hashes, images
from tagloom.functions import payloads as qr
from tagloom.functions import text as t
from tagloom.operators import boxes, candidates, components, fusion, runs, tracking
from tagloom.schema import TAG_COLUMNS
from tagloom.plans import fixtures as fx
from tagloom.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def parsed(spark, lines, payloads=()):
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    return one(spark, fields.parse_observation(arr(lines), arr(payloads))).asDict()


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["252,63", "129,99", "-48%", "03.04.2026 3:08"], {"price_default": "252.63", "price_card": "129.99", "discount_amount": "-48%", "print_datetime": "03.04.2026 3:08"}),
        (["378949"], {"price_default": "3789.49"}),
        (["2345 99"], {"price_default": "2345.99"}),
        (["0.75L"], {"price_default": ""}),
        (["599,99 руб"], {"price_default": "599.99"}),
        (["id_sku 270207736530"], {"price_default": "", "id_sku": "270207736530", "barcode": ""}),
        (["Штрих код 4670025474665"], {"price_default": "", "barcode": "4670025474665"}),
        (["129", "99"], {"price_default": "129.99"}),
        (["Вино красное сухое"], {"product_name": "Вино красное сухое", "additional_info": "сухое", "code": "нет"}),
    ],
)
def test_fields(spark, lines, want):
    got = parsed(spark, lines)
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ("b=4670025474665&p1=252.63&p4=129.99&aC=ABC", {"qr_code_barcode": "4670025474665", "price1_qr": "252.63", "price4_qr": "129.99", "action_code_qr": "ABC"}),
        ("4670025474665", {"qr_code_barcode": "4670025474665"}),
        ("(01)04670025474665", {"qr_code_barcode": "4670025474665"}),
        ('{"Barcode": "1", "price1": null}', {"qr_code_barcode": "1"}),
        ("https://x.y/z?b=1&b=2&p1=", {"qr_code_barcode": "2"}),
        ("", {}),
    ],
)
def test_payloads(spark, payload, want):
    assert one(spark, qr.parse_payload(F.lit(payload))) == want


def test_values(spark):
    assert one(spark, t.canonical(F.lit(" νες "))) == "нет"
    assert one(spark, t.price_to_str(F.lit("12,5 ₽"))) == "12.50"
    assert one(spark, hashes.hamming(F.lit("ff00"), F.lit("ff03"))) == 2
    assert one(spark, hashes.hamming(F.lit(""), F.lit("f"))) == 10**9
    assert one(spark, hashes.in_validation(F.lit("a"), F.lit(1234.4), 0.5)) == one(spark, hashes.in_validation(F.lit("a"), F.lit(1234.49), 0.5))
    assert one(spark, hashes.in_validation(F.lit("a"), F.lit(1.0), 1.0)) is True
    assert one(spark, geometry.iou(geometry.box(*map(F.lit, (0, 0, 2, 2))), geometry.box(*map(F.lit, (1, 1, 3, 3))))) == pytest.approx(1 / 7)


def test_greedy_match_as_loop(spark):
    gt, pred = fx.with_box(fx.truth(spark, "/root/testdata/sf0.001")), fx.with_box(fx.predicted(spark, "/root/testdata/sf0.001"))
    got = {(r.gt_ord, r.pred_ord) for r in boxes.greedy_match(gt, pred, "frame").collect()}
    p = {}
    for r in pred.orderBy("ord").collect():
        p.setdefault(r.frame, []).append(r)
    want, used = set(), set()
    for r in gt.orderBy("ord").collect():
        best, top = None, 0.0
        for q in p.get(r.frame, []):
            a, b = tuple(r.box), tuple(q.box)
            both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            i = both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)
            if q.ord not in used and i > top:
                best, top = q.ord, i
        if best is not None and top >= 0.35:
            used.add(best)
            want.add((r.ord, best))
    assert got == want


def test_tracker_counts(spark):
    rows = __import__("tagloom.plans.queries", fromlist=["x"]).tracks(spark, "/root/testdata/sf0.01").toPandas()
    sizes = rows.groupby(["filename", "track_id"]).size()
    assert (len(rows), len(sizes), sizes.max(), (sizes == 1).sum()) == (10000, 526, 43, 15)


def test_tracker_expires_and_splits_on_ids():
    k = tracking.Tracker(tracking.TrackerConfig(max_lost=1))
    box, none = (100.0, 100.0, 220.0, 220.0), [[], [], []]
    assert k.step([(0.9, 1, box, none)]) == {1: 1}
    k.step([])
    k.step([])
    assert k.step([(0.9, 2, box, none)]) == {2: 2}
    k = tracking.Tracker()
    k.step([(0.9, 1, box, [["46"], [], []])])
    assert k.step([(0.9, 2, box, [["47"], [], []])]) == {2: 2}


def test_groups_and_merge(spark):
    base = {"filename": "a", "frame_timestamp": 0, "x_min": 0.0, "y_min": 0.0, "x_max": 100.0, "y_max": 100.0, "product_name": "Сыр", "price_default": "1", "price_card": "", "barcode": "", "qr_code_barcode": "", "id_sku": "", "code": "", "best_text": "", "visual_hash": ""}
    make = lambda *xs: spark.createDataFrame(pd.DataFrame([base | {"ord": i} | x for i, x in enumerate(xs)]))
    groups = lambda df: [r.group_key for r in fusion.group_rows(df, fusion.duplicate_pairs(df)).orderBy("ord").collect()]
    assert len(set(groups(make({}, {"x_min": 6.0, "x_max": 106.0})))) == 1
    assert len(set(groups(make({"barcode": "1"}, {"barcode": "2"})))) == 2
    assert len(set(groups(make({}, {"x_min": 900.0, "x_max": 1000.0})))) == 2
    df = make({"product_name": "нет"}, {"product_name": "Сыр"}, {"product_name": "Масло"})
    assert fusion.merge_values(df, ["filename"], "product_name", "ord").first().product_name == "Масло"


def test_clusters(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = dict(components.clusters(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_pixels():
    red = np.zeros((20, 30, 3), np.uint8)
    red[4:12, 5:20, 2] = 255
    assert images.classify_color(red) == "red"
    assert images.color_boxes(red) == [(5, 4, 20, 12)]
    assert images.classify_color(np.full((4, 4, 3), 255)) == "white"
    assert images.sharpness(np.full((5, 5), 9.0)) == 0
    assert images.crop(red, (5, 4, 20, 12)).shape == (8, 15, 3)
    moved = np.roll(red, 3, 1)
    assert images.template_shift(red, moved, (3, 2, 22, 14), 5)[0] == (6, 2, 25, 14)


def test_csv_and_config(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿filename,barcode,wholesale_level_1_coun\nv.mp4,4670025474665,3\n", encoding="utf-8")
    row = tables.read_rows(spark, f"file://{tmp_path}/a.csv").first()
    assert (row.filename, row.barcode, row.wholesale_level_1_count, row.code) == ("v.mp4", "4670025474665", "3", "")
    tables.write_rows(tables.read_rows(spark, f"file://{tmp_path}/a.csv"), f"file://{tmp_path}/out")
    assert tables.read_rows(spark, f"file://{tmp_path}/out").first() == row
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert tables.read_config(str(tmp_path / "c.json")) == {"a": 1}
    assert tables.read_config(None) == {}
    assert tables.env_flag({"X": "On"}, "X", False)


OBS = "filename string, frame_index long, ord long, timestamp_ms long, x_min double, y_min double, x_max double, y_max double, score double, source string, text string, quality double, payloads array<string>, visual_hash string, product_name string, barcode string"


def observation(video, ord_, frame, x, source="yolo", name="", barcode="", hash_="", text="", y=100.0):
    return (video, frame, ord_, frame * 500, x, y, x + 120.0, y + 120.0, 0.9, source, text, 100.0, [], hash_, name, barcode)


def ran(spark, rows, **more):
    obs = spark.createDataFrame(rows, OBS)
    every = obs.select("filename").distinct().crossJoin(spark.range(0, 60).select(F.col("id").alias("frame_index")))
    return runs.run(every, obs, **more).collect()


def test_run_from_frames_to_rows(spark):
    n = iter(range(1000))
    one = lambda video, frame, x, **k: observation(video, next(n), frame, x, **k)
    # apart in time, so two tracks: one row if they carry the same code or lie alike with like looks, two if their codes or looks differ
    later = lambda video, a, b: [*(one(video, i, 100.0, **a) for i in range(2)), *(one(video, 9 + i, 106.0, **b) for i in range(2))]
    rows = [*(one("a", k, 100.0 + k, name="Сыр", barcode="46") for k in range(3)), one("a", 1, 3000.0, name="Молоко")]
    rows += later("b", {"barcode": "46"}, {"barcode": "46"}) + later("c", {"barcode": "46"}, {"barcode": "47"})
    rows += later("d", {"hash_": "ff00ff00ff00ff00"}, {"hash_": "ff00ff00ff00ff01"}) + later("e", {"hash_": "ff00ff00ff00ff00"}, {"hash_": "00ff00ff00ff00ff"})
    # proposals of fallback detectors need evidence
    rows += [one("f", 0, 100.0, source="heuristic", name="Сыр"), one("g", 0, 100.0, source="heuristic", barcode="46")]
    found = ran(spark, rows)
    assert [(r.product_name, r.barcode) for r in found if r.filename == "a"] == [("Сыр", "46"), ("Молоко", "")] and list(found[0].asDict()) == TAG_COLUMNS
    assert {v: sum(r.filename == v for r in found) for v in "bcdefg"} == {"b": 1, "c": 2, "d": 1, "e": 2, "f": 0, "g": 1}
    assert [r.filename for r in found] == sorted(r.filename for r in found)
    assert ran(spark, rows[:2], least=3) == []


def test_group_takes_best_row_and_common_values(spark):
    row = lambda o, name, code, n: {"ord": o, "g": "x", **{c: "" for c in TAG_COLUMNS}, "filename": "v", "frame_timestamp": o, "x_min": 0.0, "y_min": 0.0, "x_max": 10.0, "y_max": 10.0, "product_name": name, "barcode": code, "observations": n, "best_text": "", "has_qr": False}
    out = runs.fuse_groups(spark.createDataFrame([row(1, "Сыр", "", 30), row(2, "Мёд", "46", 1), row(3, "Сыр", "", 2)]), ["g"]).collect()
    assert [(r.frame_timestamp, r.product_name, r.barcode) for r in out] == [(2, "Сыр", "46")]


def test_stream_tracker_keeps_identifiers():
    k = tracking.Tracker()
    box = (0.0, 0.0, 100.0, 100.0)
    assert k.step([(0.9, 1, box, tracking.identifiers({"barcode": "46"}))]) == {1: 1}
    kept = tracking.Tracker(tracks=[tracking.Track(t.track_id, t.box, t.lost, t.ids) for t in k.tracks.values()], next_id=k.next_id)
    assert kept.step([(0.9, 2, box, tracking.identifiers({"barcode": "47"}))]) == {2: 2}


def test_regions_and_zones(spark):
    r = spark.createDataFrame([("p", i if i < 9 else None, float(i), i) for i in range(30)], "k string, prior int, score double, ord int")
    assert [x.ord for x in candidates.chosen_regions(r, "k").orderBy("place").collect()] == [*range(9), 29, 28, 27]
    z = candidates.zones(spark.createDataFrame([("a", 100, 100), ("b", 20, 90), ("c", 0, 5)], "k string, w int, h int"), "k", "w", "h").collect()
    assert [x.zone for x in sorted(z, key=lambda x: (x.k, x.i))] == ["full", "product_top", "price_left", "lower_codes", "center", "full"]
