"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import math
import re
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry
from tagloom.plans import fixtures as fx
from tagloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
#: Tracks have 25 rows here, 2 or 3 in SF.
SF_WHOLE = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def brute_duplicates(found):
    """Pairs of rows, one by one, by the conditions of fusion.duplicate_pairs in plain Python."""
    name = lambda x: re.sub(r"\s+", " ", re.sub(r"[^0-9a-zа-я]+", " ", x.lower().replace("ё", "е"))).strip()
    text = {r.ord: name(" ".join(x for x in (r.product_name, r.price_default, r.best_text) if x not in ("", "нет"))) for r in found}
    out = set()
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            gap = abs(a.frame_timestamp - b.frame_timestamp)
            if a.filename != b.filename or gap > 12000 or (a.barcode and b.barcode and a.barcode != b.barcode):
                continue
            wa, wb, ha, hb = a.x_max - a.x_min, b.x_max - b.x_min, a.y_max - a.y_min, b.y_max - b.y_min
            ox, oy = max(0.0, min(a.x_max, b.x_max) - max(a.x_min, b.x_min)), max(0.0, min(a.y_max, b.y_max) - max(a.y_min, b.y_min))
            dx, dy = abs(a.x_min + a.x_max - b.x_min - b.x_max) / 2, abs(a.y_min + a.y_max - b.y_min - b.y_max) / 2
            over, heights, widths, tallest = oy / min(ha, hb), min(ha, hb) / max(ha, hb), min(wa, wb) / max(wa, wb), max(ha, hb)
            iou = ox * oy / (wa * ha + wb * hb - ox * oy)
            near = iou >= 0.30 or (over >= 0.70 and heights >= 0.60 and dx <= 90 and dy <= tallest * 0.35 and widths >= 0.55)
            loose = iou >= 0.30 or (over >= 0.55 and heights >= 0.48 and dx <= 180 and dy <= tallest * 0.55 and widths >= 0.42)
            row = heights >= 0.45 and (over >= 0.45 or dy <= tallest * 0.55) and widths >= 0.40
            close = len(a.visual_hash) == len(b.visual_hash) and (int(a.visual_hash, 16) ^ int(b.visual_hash, 16)).bit_count() <= 14
            s, t = (text[x.ord] for x in sorted((a, b), key=lambda x: x.ord))
            alike = row and (close or loose) and s and t and (s == t or SequenceMatcher(None, s, t).ratio() >= 0.86)
            if (gap <= 1600 and near) or (row and close and near) or alike:
                out.add(tuple(sorted((a.ord, b.ord))))
    return out


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.SQL.keys()))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0


def test_all_detections_are_truth(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    met = plans.greedy_match(spark, SF)
    assert fx.truth(spark, SF).count() == met.count() + plans.unmatched_truth(spark, SF).count() == n
    assert plans.evaluation_summary(spark, SF).where(f"gt_rows = {n}").count() > 0


def test_all_rows_are_asked_for_duplicates(spark):
    rows = plans.dedupe_rows(spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows.count() == plans.row_groups(spark, SF).count() == n
    got = {(r.a, r.b) for r in plans.duplicate_pairs(spark, SF).collect()}
    assert got == brute_duplicates(rows.collect())


@pytest.mark.parametrize("name", ["frame_lookup", "source_gate", "trajectories", "detector_misses", "detector_recall", "row_similarity"])
def test_whole_job(spark, duck, name):
    df = plans.QUERIES[name](spark, SF_WHOLE)
    want = duck.execute(plans.SQL[name].replace("FROM events", f"FROM '{SF_WHOLE}/events.parquet'"))
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
