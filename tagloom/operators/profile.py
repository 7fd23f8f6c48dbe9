"""Evaluation, coverage and data profiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from ..schema import COMPARED_COLUMNS
from . import quantiles


def describe(rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """A row for each column (and keys): min, tenths, median, max and mean, interpolated, three decimals."""
    keys = keys or []
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(*keys, "x.name", "x.v").where("v IS NOT NULL")
    ends = long.groupBy(F.struct(*keys, "name").alias("g")).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    at = lambda n, s: F.max(F.when(F.col("share") == s, F.col("value"))).alias(n)
    tenths = quantiles.quantiles(rows, keys, columns, [0.1, 0.5, 0.9]).groupBy(F.struct(*keys, "name").alias("g")).agg(at("p10", 0.1), at("p50", 0.5), at("p90", 0.9))
    return ends.join(tenths, "g").select("g.*", *(F.round(c, 3).alias(c) for c in ("min", "p10", "p50", "p90", "max", "mean")))


def fill_rate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name and share of filled values of each column, four decimals."""
    ok = lambda c: ~(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("", "nan") | (F.trim(F.col(c)) == "нет"))
    one = rows.agg(*(F.round(F.avg(F.when(ok(c), 1.0).otherwise(0.0)), 4).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("rate")) for c in columns))).alias("x")).select("x.*")


def fill_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name and number of filled values of each column that has any."""
    one = rows.agg(*(F.count_if(t.filled(F.col(c))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").where("n > 0")


def row_similarity(gt: str, pred: str) -> Column:
    """Likeness of two rows (aliases): mostly the share of equal fields, partly their boxes' overlap."""
    norm = lambda s, c: F.replace(F.lower(t.normalize_text(F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit("")))), F.lit(","), F.lit("."))
    hits, total = F.lit(0.0), F.lit(0)
    for c in COMPARED_COLUMNS:
        a, b = norm(gt, c), norm(pred, c)
        asked = ~a.isin("", "nan")
        hit = F.when((a == b) | ((a == "нет") & b.isin("нет", "")), 1.0)
        if c == "product_name":
            words, others = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
            hit = hit.when((b != "") & (F.size(F.array_intersect(words, others)) / F.size(words) >= 0.65), 0.75)
        hits, total = hits + F.when(asked, hit.otherwise(0.0)).otherwise(0.0), total + F.when(asked, 1).otherwise(0)
    boxes = [g.box(*(F.col(f"{s}.{c}") for c in ("x_min", "y_min", "x_max", "y_max"))) for s in (gt, pred)]
    return 0.85 * (hits / F.greatest(F.lit(1), total)) + 0.15 * g.iou(*boxes)


def evaluate(gt: DataFrame, pred: DataFrame, matches: DataFrame, good: float = 0.80) -> DataFrame:
    """One row: rows, matches and good matches, and their shares of the gt rows. matches: gt_ord, pred_ord."""
    met = matches.select("gt_ord", "pred_ord").join(gt.alias("g"), F.col("gt_ord") == F.col("g.ord")).join(pred.alias("p"), F.col("pred_ord") == F.col("p.ord"))
    found = met.agg(F.count("*").alias("m"), F.count_if(row_similarity("g", "p") >= good).alias("k"))
    counts = gt.agg(F.count("*").alias("n")).crossJoin(pred.agg(F.count("*").alias("p"))).crossJoin(found)  # one row each
    n = F.greatest(F.lit(1), F.col("n"))
    d = lambda c: F.col(c).cast("double")
    return counts.select(d("n").alias("gt_rows"), d("p").alias("pred_rows"), d("m").alias("matched_rows"), d("k").alias("good_rows_at_80"), (F.col("k") / n).alias("success_metric_proxy"), (F.col("m") / n).alias("detection_recall_proxy"))


def evenly_spaced(rows: DataFrame, by: str, ord_: str, k: int, keys: list[str]) -> DataFrame:
    """k rows of each key at even steps of the order by a column."""
    order = Window.partitionBy(*keys).orderBy(by, ord_)
    at = rows.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / max(1, k - 1)))
    return at.where(F.array_contains(steps, F.col("__i").cast("long"))).drop("__i", "__n")


def frame_stats(detections: DataFrame, observed: Column) -> DataFrame:
    """Detections and observations of each frame, and the detections of its video."""
    per = detections.groupBy("filename", "frame_index").agg(F.count("*").alias("detections"), F.count_if(observed).alias("observations"))
    return per.withColumn("total", F.sum("detections").over(Window.partitionBy("filename")))


def joined_artifacts(runs: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """What each run has of several results; nulls where one is missing."""
    for part in parts:
        runs = runs.join(part, key, "left")
    return runs


def diagnostics(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows, rows without evidence and filled fields by keys."""
    some = [t.filled(F.col(c)) for c in columns]
    none = ~functools.reduce(Column.__or__, some)
    return rows.groupBy(*keys).agg(F.count("*").alias("pred"), F.count_if(none).alias("no_evidence"), *(F.count_if(x).alias(c) for c, x in zip(columns, some, strict=True)))
