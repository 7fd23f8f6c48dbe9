"""Groups of rows against the fold over each video that they stand for, whatever the blocks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.operators import fusion
from tagloom.plans import fixtures as fx
from tagloom.plans import queries

SCHEMA = "ord long, filename string, frame_timestamp long, barcode string, qr_code_barcode string, id_sku string, code string"


def plainly(rows, pairs):
    """Rows with a key first, then the others; each joins its key's group, or the first group with a duplicate of it, or begins one."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for video in sorted({r["filename"] for r in rows}):
        groups = {}
        own = [r for r in rows if r["filename"] == video]
        for r in sorted(own, key=lambda r: (r["barcode"] == "", r["ord"])):
            key = "barcode:" + r["barcode"] if r["barcode"] else next((k for k, held in groups.items() if near[r["ord"]] & held), f"track:{r['ord']}")
            groups.setdefault(key, set()).add(r["ord"])
            out[r["ord"]] = key
    return out


@pytest.mark.parametrize("block", [3, 25, 10_000])
def test_groups_as_the_fold(spark, block):
    rng = random.Random(block)
    rows = [{"ord": i, "filename": "v" if i % 7 else "w", "frame_timestamp": i * 400 + rng.randint(0, 900), "barcode": f"46{rng.randint(0, 9)}" if rng.random() < 0.2 else "", "qr_code_barcode": "", "id_sku": "", "code": ""} for i in range(150)]
    pairs = {(a, b) for a in range(150) for b in range(a + 1, min(a + 9, 150)) if rng.random() < 0.12 and rows[a]["filename"] == rows[b]["filename"]}
    pairs |= {(a, a + 1) for a in range(30, 70) if rows[a]["filename"] == rows[a + 1]["filename"]}  # a chain over many blocks
    found = fusion.group_rows(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sorted(pairs), "a long, b long"), block)
    assert {r["ord"]: r.group_key for r in found.collect()} == plainly(rows, pairs)


def test_no_rows_and_no_pairs(spark):
    none, rows = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(5, "v", 0, "", "", "", "")], SCHEMA)
    assert fusion.group_rows(rows.where("false"), none).collect() == []
    assert [r.group_key for r in fusion.group_rows(rows, none).collect()] == ["track:5"]


def test_row_groups_query(spark):
    sf = "/root/testdata/sf0.001"
    pairs = {(r.a, r.b) for r in queries.duplicate_pairs(spark, sf).collect()}
    rows = [r.asDict() for r in queries.dedupe_rows(spark, sf).select("ord", "filename", F.col("barcode")).collect()]
    assert {r["ord"]: r.group_key for r in queries.row_groups(spark, sf).collect()} == plainly(rows, pairs)
    assert fx.obs(spark, sf).count() == len(rows)
