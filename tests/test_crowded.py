"""Frames and videos with very many rows: the results of plain rules, in time and memory that grow with the rows."""

import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry, payloads
from tagloom.operators import boxes, candidates, fusion, propagation, tracking
from tagloom.plans import fixtures as fx
from tagloom.plans import queries

N = 30_000


@pytest.fixture
def crowd(spark):
    """One frame of boxes 100 wide, 60 apart, so that each overlaps its neighbours alone: by 40 of 160 in length."""
    x = (F.col("id") * 60).cast("double")
    return spark.range(N).select(F.lit("f").alias("frame"), F.col("id").alias("ord"), (F.col("id") % 7 / 10).alias("score"), geometry.box(x, F.lit(0.0), x + 100, F.lit(50.0)).alias("box"))


def in_time(df, seconds=60):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < seconds
    return rows


@pytest.mark.parametrize("copies", [1, 3])
def test_suppression(spark, crowd, copies):
    many = crowd.withColumn("ord", F.explode(F.sequence(F.col("ord") * copies, F.col("ord") * copies + copies - 1)))
    kept, gone = set(), set()
    for i in sorted(range(N), key=lambda i: (-(i % 7), i)):
        (gone if {i - 1, i + 1} & kept else kept).add(i)
    assert {r.ord for r in in_time(boxes.suppress(many, ["frame"], 0.2))} == {i * copies for i in kept}


def test_suppression_of_null_keys_and_wide_boxes(spark):
    rows = [(None, 0, 0.9, 0.0, 1e12), (None, 1, 0.8, 5e11, 1e12), ("a", 2, 0.7, 0.0, 10.0), ("a", 3, 0.9, 1.0, 10.0), (None, 4, 0.1, -9e12, -8e12)]
    df = spark.createDataFrame(rows, "k string, ord long, score double, x double, z double").select("k", "ord", "score", geometry.box(F.col("x"), F.lit(0.0), F.col("z"), F.lit(1.0)).alias("box"))
    assert {r.ord for r in boxes.suppress(df, ["k"], 0.4).collect()} == {0, 3, 4}
    # anything hits where no overlap is asked for
    assert {r.ord for r in boxes.suppress(df, ["k"], 0.0).collect()} == {0, 3}


def test_matches_and_overlaps(spark, crowd):
    pred = crowd.withColumn("ord", F.col("ord") + N)
    assert {(r.gt_ord, r.pred_ord, r.iou) for r in in_time(boxes.greedy_match(crowd, pred, "frame"))} == {(i, i + N, 1.0) for i in range(N)}
    assert {(r.best_iou, r.n_pred) for r in in_time(boxes.best_overlap(crowd.select("frame", "ord", "box"), pred, ["frame"]))} == {(1.0, N)}
    alone = spark.createDataFrame([("f", 1), ("g", 2)], "frame string, ord long").select("*", geometry.box(F.lit(-50.0), F.lit(0.0), F.lit(-10.0), F.lit(50.0)).alias("box"))
    assert {tuple(r[c] for c in ("ord", "best_iou", "n_pred")) for r in boxes.best_overlap(alone, pred, ["frame"]).collect()} == {(1, 0.0, N), (2, 0.0, 0)}


def test_sources(spark, crowd):
    found = crowd.withColumn("source", F.concat(F.lit("s"), "ord")).unionByName(crowd.selectExpr("frame", "ord + 100000 AS ord", "score + 1 AS score", "box", "'better' AS source"))
    assert {(r.ord, r.source) for r in in_time(candidates.recovered_sources(crowd.select("frame", "ord", "box"), found, ["frame"]))} == {(i, "better") for i in range(N)}


def test_tracker_memory():
    """Twenty thousand tracks go on in the next frame; no table of all pairs is made."""
    n = 20_000
    box = lambda i: (i * 60.0, 0.0, i * 60.0 + 50, 50.0)
    k = tracking.Tracker()
    k.step([(0.5, i, box(i), [[], [], []]) for i in range(n)])
    tracemalloc.start()
    try:
        got = k.step([(0.5, i + n, box(i), [[], [], []]) for i in range(n)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == {i + n: i + 1 for i in range(n)}
    assert peak < 300e6


def test_equal_boxes_move_once(monkeypatch):
    """A picture's equal boxes are looked for once, and each row gets what became of its own."""
    asked = []
    monkeypatch.setattr(propagation.images, "template_shift", lambda before, after, b, reach: (asked.append(b), ((b[0] + 1, *b[1:]), 0.9))[1])
    held = {i: (i % 3, 0, 20, 20) for i in range(300)}
    out = propagation.chain({0: "x", 1: "y"}, 0, held, 1, 4, 0.5)
    assert len(asked) == 3
    assert {(o, b) for _, o, b, _ in out} == {(i, (i % 3 + 1, 0, 20, 20)) for i in range(300)}


def test_meeting_by_hashes(spark):
    """Rows that meet through their distinct hashes are those that meet and have like hashes, each pair once."""
    r = (F.xxhash64("id") % 1000 + 1000) % 1000
    rows = spark.range(400).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 5 == 0, "w").otherwise("v").alias("filename"), (r * 37).alias("frame_timestamp"), (F.col("id") * 300.0).alias("x_min"), (r % 500).cast("double").alias("y_min"), (F.col("id") * 300.0 + 100).alias("x_max"), (r % 500 + 200.0).alias("y_max"),
        *(F.lit("").alias(c) for c in ("product_name", "price_default", "price_card", "barcode", "qr_code_barcode", "id_sku", "code", "best_text")),
        F.when(F.col("id") % 11 != 0, F.substring(F.lpad(F.hex(F.col("id") % 60 * 77), 16, "f"), 1, F.when(F.col("id") % 7 == 0, 15).otherwise(16))).alias("visual_hash"),
    )
    slim = fusion.comparable(rows)
    cells = fusion.cells_between(F.col("box.y_min"), F.col("box.y_max"), 128.0)
    pairs = lambda df: sorted((r.a, r.b) for r in df.select(F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).collect())
    close = (F.col("x.digits") == F.col("y.digits")) & (F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= 3)
    want = pairs(fusion.meet(slim, 12000, cells).where(close))
    assert len(want) > 300 and pairs(fusion.meet(slim, 12000, cells, 3)) == want


def test_tag_texts_are_dealt_out(spark):
    """The table of parts is one small file; its texts are parsed by as many tasks as a shuffle has."""
    assert fx.tag_text(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_payloads_are_parsed_once_and_dealt_out(spark):
    """Fields that are filled up with absent ones are worked out once, and by as many tasks as a shuffle has."""
    df = spark.createDataFrame([(["b=46000000001&p4=12,5"],), ([],)], "ps array<string>")
    fields = lambda made: payloads.with_absent(F.create_map(F.lit("price4_qr"), made), F.col("ps"))
    assert df.select(fields(F.upper(F.col("ps")[0])).alias("m"))._jdf.queryExecution().analyzed().toString().count("upper(") == 1
    out = df.select("ps", payloads.with_absent(payloads.parse_payloads(F.col("ps")), F.col("ps")).alias("m"))
    rows = {len(r.ps): r.m for r in out.collect()}
    assert rows[1]["price4_qr"] == "12.50" and rows[1]["price2_qr"] == "нет" and rows[0] == {}
    for name in ("merged_payloads", "payload_fields"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
