"""Operators on sets of boxes: suppression, greedy matching, recall, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


#: Width of the cells along the shelf in which boxes meet, and the last cell on either side: what lies beyond shares it.
CELL, LAST_CELL = 256.0, 65_536


def cell(x: Column) -> Column:
    return F.greatest(F.lit(-LAST_CELL), F.least(F.lit(LAST_CELL), F.floor(x / CELL))).cast("int")


def meeting(a: DataFrame, b: DataFrame, keys: list[str], box_a: str = "a", box_b: str = "b") -> DataFrame:
    """Pairs of rows of equal keys whose boxes share a cell along the shelf, each once: all that overlap are among them."""
    low, high = (lambda c: F.least(f"{c}.x_min", f"{c}.x_max")), (lambda c: F.greatest(f"{c}.x_min", f"{c}.x_max"))
    placed = lambda df, c, first: df.withColumn(first, cell(low(c))).withColumn("__cell", F.explode(F.sequence(F.col(first), cell(high(c)))))
    met = placed(a, box_a, "__first_a").join(placed(b, box_b, "__first_b"), [*keys, "__cell"])
    return met.where(F.col("__cell") == F.greatest("__first_a", "__first_b")).drop("__cell", "__first_a", "__first_b")


def suppress(df: DataFrame, keys: list[str], overlap: float, measure=g.iou, strict: bool = True) -> DataFrame:
    """Rows that stay when each row goes that overlaps a better one that stays, within the keys; columns box, score, ord.

    Overlapping pairs are joined first. What is hit by better rows then streams through a task, best first, which holds
    the numbers of one group's rows that went. Of equal boxes only the best is looked at where they hit one another.
    The measure is 0 for boxes that don't overlap.
    """
    hit = lambda k, x: measure(k, x) >= overlap if strict else measure(k, x) > overlap
    rest = [c for c in df.columns if c not in keys]
    best_first = [(-F.col("score")).asc(), "ord", *(c for c in rest if c not in ("score", "ord"))]
    ranked = df.withColumn("__k", F.to_json(F.struct(*keys))).withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*best_first)))
    copies = Window.partitionBy("__k", "box").orderBy("__r")
    ranked = ranked.withColumn("__c", F.row_number().over(copies)).where(F.col("__c").eqNullSafe(1) | ~F.coalesce(hit(F.col("box"), F.col("box")), F.lit(False))).drop("__c")
    slim = ranked.select("__k", "__r", "box")
    better, worse = (slim.select("__k", F.col("__r").alias(r), F.col("box").alias(b)) for r, b in (("by", "a"), ("__r", "b")))
    near = meeting(better, worse, ["__k"]) if overlap > 0 or (overlap == 0 and not strict) else better.join(worse, "__k")
    hits = near.where("by < __r").where(hit(F.col("a"), F.col("b"))).groupBy("__k", "__r").agg(F.collect_list("by").alias("by"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, gone = None, set()
        for pdf in batches:
            out = []
            for k, r, by in zip(pdf["__k"].tolist(), pdf["__r"].tolist(), pdf["by"].tolist(), strict=True):
                if k != group:
                    group, gone = k, set()
                if any(x not in gone for x in by.tolist()):
                    gone.add(r)
                    out.append((k, r))
            yield pd.DataFrame(out, columns=["__k", "__r"])

    went = hits.repartition("__k").sortWithinPartitions("__k", "__r").mapInPandas(run, "__k string, __r int")
    return ranked.join(went, ["__k", "__r"], "left_anti").select(*keys, *rest)


def greedy_match(gt: DataFrame, pred: DataFrame, key: str, least_iou: float = 0.35) -> DataFrame:
    """key, gt_ord, pred_ord, iou: each gt row, in order, takes the unused pred row of largest overlap (the earliest of equal ones).

    gt, pred: key, ord, box. Pairs that overlap enough are joined first; sorted by Spark, they stream through a task that
    holds the used rows of one key.
    """
    a = gt.where(g.valid(F.col("box"))).select(key, F.col("ord").cast("bigint").alias("gt_ord"), F.col("box").alias("a"))
    b = pred.where(g.valid(F.col("box"))).select(key, F.col("ord").cast("bigint").alias("pred_ord"), F.col("box").alias("b"))
    pairs = meeting(a, b, [key]).withColumn("iou", g.iou(F.col("a"), F.col("b"))).where(F.col("iou") >= least_iou if least_iou > 0 else F.col("iou") > 0).select(key, "gt_ord", "pred_ord", "iou")
    ordered = pairs.repartition(key).sortWithinPartitions(key, "gt_ord", F.desc("iou"), "pred_ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, used = None, None, set()
        for pdf in batches:
            taken = []
            for i, (k, o, p) in enumerate(zip(pdf[key].tolist(), pdf["gt_ord"].tolist(), pdf["pred_ord"].tolist(), strict=True)):
                if k != group:
                    group, last, used = k, None, set()
                if o != last and p not in used:
                    last = o
                    used.add(p)
                    taken.append(i)
            yield pdf.iloc[taken]

    return ordered.mapInPandas(run, ordered.schema)


def best_overlap(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """gt rows with best_iou and n_pred among the pred rows of the same keys; a pred row may serve many.

    Rows that may overlap meet in cells; the others are only counted.
    """
    i = g.iou(F.col("box"), F.col("__b"))
    met = meeting(gt, pred.select(*keys, F.col("box").alias("__b")), keys, "box", "__b").withColumn("__i", i).where("__i > 0").select(*gt.columns, "__i", F.lit(0).alias("__m"))
    each = gt.select("*", F.lit(0.0).alias("__i"), F.lit(1).alias("__m")).unionByName(met).groupBy(*gt.columns).agg(F.max("__i").alias("best_iou"), F.sum("__m").alias("__m"))
    counts = pred.groupBy(*keys).agg(F.count("box").alias("__n"))
    return each.join(counts, keys, "left").select(*gt.columns, "best_iou", (F.col("__m") * F.coalesce("__n", F.lit(0))).alias("n_pred"))


def band_pairs(a: DataFrame, b: DataFrame, key: str, time_a: str, time_b: str, band: int, strict: bool) -> DataFrame:
    """Pairs of equal key whose times differ by at most `band` (strict: less): by buckets of that width, so each row meets three."""
    left = a.withColumn("__t", F.explode(F.array(*(F.floor(F.col(time_a) / band) + i for i in (-1, 0, 1)))))
    right = b.withColumn("__t", F.floor(F.col(time_b) / band))
    d = F.abs(F.col(time_a) - F.col(time_b))
    return left.join(right, [key, "__t"]).where(d < band if strict else d <= band).drop("__t")
