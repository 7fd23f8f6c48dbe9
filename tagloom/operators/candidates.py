"""Candidate boxes of tags and of parts of tags, as arithmetic on boxes: expansions, filters, scores, zones, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# How far a price panel is widened to either side, and a strip up and down.
PANEL_WIDTHS = (2.1, 2.5, 2.85, 3.2)
STRIP_HEIGHTS = (2.0, 2.4, 2.8)
# Fractions of a tag's picture that are read by themselves.
ZONES = {
    "full": (0.00, 0.00, 1.00, 1.00), "product_top": (0.00, 0.00, 1.00, 0.62), "price_left": (0.00, 0.18, 0.58, 0.92),
    "price_right": (0.42, 0.18, 1.00, 0.92), "lower_codes": (0.00, 0.55, 1.00, 1.00), "center": (0.12, 0.12, 0.88, 0.88),
}
SMALL_PICTURE, SMALL_ZONE = 24, 18
# Fractions of a tag's picture in which a code often lies.
PRIORS = (
    (0.45, 0.00, 1.00, 1.00), (0.35, 0.10, 1.00, 1.00), (0.50, 0.35, 1.00, 1.00), (0.00, 0.35, 0.70, 1.00), (0.00, 0.00, 0.70, 0.70),
    (0.00, 0.55, 1.00, 1.00), (0.00, 0.00, 1.00, 0.50), (0.00, 0.00, 0.50, 1.00), (0.25, 0.25, 0.85, 0.90),
)
MOST_REGIONS, SPARE = 12, 4


def panel_candidates(b: Column) -> Column:
    """array<struct(k, box)>: a panel's box widened to the right or left, or a strip's box to below or above."""
    w, h = g.width(b), g.height(b)
    made = lambda *v: g.box(*v)
    boxes = []
    for m in PANEL_WIDTHS:
        boxes.append(made(b["x_min"] - w * 0.10, b["y_min"] - h * 0.06, b["x_min"] + w * m, b["y_min"] + h * 1.06))
        boxes.append(made(b["x_min"] - w * (m - 1.0), b["y_min"] - h * 0.06, b["x_min"] + w * 1.10, b["y_min"] + h * 1.06))
    for m in STRIP_HEIGHTS:
        boxes.append(made(b["x_min"] - w * 0.06, b["y_min"] - h * 0.10, b["x_min"] + w * 1.06, b["y_min"] + h * m))
        boxes.append(made(b["x_min"] - w * 0.06, b["y_min"] - h * (m - 1.0), b["x_min"] + w * 1.06, b["y_min"] + h * 1.10))
    return F.array(*(F.struct(F.lit(k).alias("k"), x.alias("box")) for k, x in enumerate(boxes)))


def red_white_ok(b: Column, w: Column, h: Column, red: Column, white: Column, edge: Column, most_area: float = 0.05) -> Column:
    """Whether a clipped candidate has the size, shape and colours of a red and white tag."""
    cw, ch = g.width(b), g.height(b)
    shape, area = cw / F.greatest(F.lit(1.0), ch), cw * ch
    size = (cw >= 24) & (ch >= 24) & (cw <= F.greatest(w * 0.18, F.lit(260.0))) & (ch <= F.greatest(h * 0.32, F.lit(260.0)))
    size = size & (area / F.greatest(F.lit(1.0), w * h) >= 0.0008) & (area <= F.greatest(w * h * most_area, F.lit(60000.0)))
    return size & shape.between(0.24, 1.85) & (red >= 0.045) & (white >= 0.16) & (edge >= 0.012)


def red_white_score(b: Column, w: Column, h: Column, red: Column, white: Column, edge: Column) -> Column:
    """Weighted sum of the shares of red, white and edges, and of how usual shape and area are."""
    one, zero = F.lit(1.0), F.lit(0.0)
    shape = g.width(b) / F.greatest(one, g.height(b))
    part = g.area(b) / F.greatest(one, w * h)
    usual = lambda x, at, within: F.greatest(zero, 1.0 - F.abs(x - at) / within)
    colours = F.least(one, red / 0.30) * 0.18 + F.least(one, white / 0.45) * 0.18 + F.least(one, edge / 0.08) * 0.14
    return F.lit(0.45) + colours + usual(shape, 0.82, 0.82) * 0.12 + usual(part, 0.0075, 0.016) * 0.08


def colour_ok(b: Column, area: Column, least_area: float, most_area: Column) -> Column:
    """Whether a contour of this area in its bounding box may be a tag's coloured part."""
    w, h = g.width(b), g.height(b)
    shape, fill = w / F.greatest(F.lit(1.0), h), area / F.greatest(F.lit(1.0), w * h)
    return area.between(F.lit(least_area), most_area) & (w >= 8) & (h >= 8) & shape.between(0.18, 6.0) & (fill >= 0.10)


def colour_box(b: Column, w: Column, h: Column) -> Column:
    """The box around a coloured part in which the whole tag lies."""
    px = F.floor(F.greatest(F.lit(14.0), F.least(F.lit(110.0), g.width(b) * 0.70)))
    py = F.floor(F.greatest(F.lit(12.0), F.least(F.lit(115.0), g.height(b) * 0.85)))
    return g.clip(g.box(b["x_min"] - px, b["y_min"] - py, b["x_max"] + px, b["y_max"] + py), w, h)


def colour_whole_ok(b: Column, w: Column, h: Column, edge: Column, white: Column) -> Column:
    """Whether the padded box isn't too large, nor a smooth white one."""
    cw, ch = g.width(b), g.height(b)
    return ~(white & (edge < 0.02)) & (cw * ch <= w * h * 0.020) & (cw <= w * 0.34) & (ch <= h * 0.45)


def colour_score(fill: Column, edge: Column) -> Column:
    return F.lit(0.35) + F.least(F.lit(0.45), fill * 0.45) + F.least(F.lit(0.20), edge)


def zones(pictures: DataFrame, key: str, w: str, h: str) -> DataFrame:
    """key, zone, x1, y1, x2, y2 of each picture's zones in pixels, in order; of zones of one size the first, the full one always."""
    made = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("zone"), *(F.lit(v).alias(c) for c, v in zip("abcd", z, strict=True))) for i, (n, z) in enumerate(ZONES.items())))
    px = lambda f, side, least, most: F.greatest(F.lit(0), F.least(most, F.rint(F.col(f"z.{f}") * F.col(side)).cast("int"))) if least else None
    z = pictures.select(key, F.col(w).alias("__w"), F.col(h).alias("__h"), F.explode(made).alias("z"))
    z = z.select(key, "__w", "__h", "z.i", "z.zone", px("a", "__w", True, F.col("__w") - 1).alias("x1"), px("b", "__h", True, F.col("__h") - 1).alias("y1"), px("c", "__w", True, F.col("__w")).alias("x2"), px("d", "__h", True, F.col("__h")).alias("y2"))
    small = (F.col("__w") < SMALL_PICTURE) | (F.col("__h") < SMALL_PICTURE)
    fits = F.when(small, F.col("zone") == "full").otherwise((F.col("x2") - F.col("x1") >= SMALL_ZONE) & (F.col("y2") - F.col("y1") >= SMALL_ZONE))
    same = Window.partitionBy(key, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).orderBy("i")
    return z.where(fits & (F.col("__w") > 0) & (F.col("__h") > 0)).withColumn("__r", F.row_number().over(same)).where("__r = 1 OR zone = 'full'").select(key, "i", "zone", "x1", "y1", "x2", "y2")


def priors(w: Column, h: Column) -> Column:
    """array<struct(k, x1, y1, x2, y2)>: where a code may lie, in whole pixels."""
    at = lambda f, side: F.floor(side * f).cast("int")
    return F.array(*(F.struct(F.lit(k).alias("k"), at(a, w).alias("x1"), at(b, h).alias("y1"), at(c, w).alias("x2"), at(d, h).alias("y2")) for k, (a, b, c, d) in enumerate(PRIORS)))


def chosen_regions(regions: DataFrame, key: str, most: int = MOST_REGIONS) -> DataFrame:
    """regions: key, prior (its place, null for contours), score, ord. Priors in order, then contours by falling score, `most` in all."""
    of = Window.partitionBy(key)
    ranked = regions.withColumn("__n", F.count("prior").over(of)).withColumn("__r", F.row_number().over(of.orderBy(F.col("prior").isNull(), "prior", F.desc("score"), "ord")))
    spare = F.greatest(F.lit(0), most - F.col("__n")) + SPARE
    return ranked.where((F.col("__r") <= most) & (F.col("__r") <= F.col("__n") + spare)).select(key, "ord", F.col("__r").alias("place"))


def recovered_sources(kept: DataFrame, found: DataFrame, keys: list[str], within: float = 4.0) -> DataFrame:
    """kept with the source of the best-scored found box whose sides differ by less than `within` in sum.

    Of equal found boxes only the best counts; left sides meet in cells along the shelf.
    """
    rank = F.struct(F.col("score").alias("c"), (-F.col("ord")).alias("o"))
    f = found.groupBy(*keys, F.col("box").alias("__b")).agg(F.max_by("source", rank).alias("__s"), F.max(rank).alias("__c"))
    size = max(64.0, within)
    at = lambda x: F.floor(x / size)
    k = kept.withColumn("__cell", F.explode(F.sequence(at(F.col("box.x_min") - within), at(F.col("box.x_min") + within))))
    apart = sum((F.abs(F.col(f"box.{c}") - F.col(f"__b.{c}")) for c in ("x_min", "y_min", "x_max", "y_max")), F.lit(0.0))
    met = k.join(f.withColumn("__cell", at(F.col("__b.x_min"))), [*keys, "__cell"]).where(apart < within)
    return met.groupBy(*keys, "ord").agg(F.max_by("__s", "__c").alias("source"))
