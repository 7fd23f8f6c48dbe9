"""Boxes as Column expressions. A box is a struct with x_min, y_min, x_max, y_max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(*cols: str | Column) -> Column:
    """A box of four columns, those of the tag row by default."""
    cols = cols or ("x_min", "y_min", "x_max", "y_max")
    return F.struct(*(F.expr(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip(cols, ("x_min", "y_min", "x_max", "y_max"), strict=True)))


def width(b: Column) -> Column:
    return b["x_max"] - b["x_min"]


def height(b: Column) -> Column:
    return b["y_max"] - b["y_min"]


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection by union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection by the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def valid(b: Column) -> Column:
    whole = F.lit(True)
    for c in ("x_min", "y_min", "x_max", "y_max"):
        whole = whole & b[c].isNotNull() & ~F.isnan(b[c])
    return F.coalesce(whole & (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"]), F.lit(False))


def clip(b: Column, w: Column, h: Column) -> Column:
    """Within the picture, ends in order."""
    into = lambda v, most: F.greatest(F.lit(0.0), F.least(most - 1.0, v))
    x1, x2, y1, y2 = into(b["x_min"], w), into(b["x_max"], w), into(b["y_min"], h), into(b["y_max"], h)
    return F.struct(F.least(x1, x2).alias("x_min"), F.least(y1, y2).alias("y_min"), F.greatest(x1, x2).alias("x_max"), F.greatest(y1, y2).alias("y_max"))


def expanded(b: Column, by_x: float, by_y: float, w: Column, h: Column) -> Column:
    """Padded by fractions of its sides, within the picture."""
    px, py = width(b) * by_x, height(b) * by_y
    return clip(F.struct((b["x_min"] - px).alias("x_min"), (b["y_min"] - py).alias("y_min"), (b["x_max"] + px).alias("x_max"), (b["y_max"] + py).alias("y_max")), w, h)


def center(b: Column) -> tuple[Column, Column]:
    return (b["x_min"] + b["x_max"]) / 2, (b["y_min"] + b["y_max"]) / 2


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def match_score(a: Column, b: Column, least_iou: float, most_distance: float) -> Column:
    """How well a detection continues a track: -1 if it lies neither over it nor near it."""
    i, d = iou(a, b), distance(a, b)
    return F.when((i < least_iou) & (d > most_distance), F.lit(-1.0)).otherwise(i * 10.0 - d / max(1.0, most_distance))


def _sides(a: Column, b: Column) -> dict[str, Column]:
    one = F.lit(1.0)
    wa, ha, wb, hb = (F.greatest(one, f(x)) for x in (a, b) for f in (width, height))
    (ax, ay), (bx, by) = center(a), center(b)
    over = F.greatest(F.lit(0.0), F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])) / F.greatest(one, F.least(ha, hb))
    return {"y_overlap": over, "heights": F.least(ha, hb) / F.greatest(ha, hb), "widths": F.least(wa, wb) / F.greatest(wa, wb), "dx": F.abs(ax - bx), "dy": F.abs(ay - by), "tallest": F.greatest(ha, hb)}


def near(a: Column, b: Column, loose: bool = False, least_iou: float = 0.30, most_dx: float = 90.0) -> Column:
    """Whether two boxes may be one tag: they overlap, or lie alike in a row."""
    s = _sides(a, b)
    over, heights, widths, dy, times = (0.55, 0.48, 0.42, 0.55, 2.0) if loose else (0.70, 0.60, 0.55, 0.35, 1.0)
    row = (s["y_overlap"] >= over) & (s["heights"] >= heights) & (s["dx"] <= most_dx * times) & (s["dy"] <= s["tallest"] * dy) & (s["widths"] >= widths)
    return (iou(a, b) >= least_iou) | row


def same_shelf_row(a: Column, b: Column, most_dy: float = 0.55) -> Column:
    s = _sides(a, b)
    return (s["heights"] >= 0.45) & ((s["y_overlap"] >= 0.45) | (s["dy"] <= s["tallest"] * most_dy)) & (s["widths"] >= 0.40)


def yolo_line(b: Column, w: Column, h: Column, label: int = 0) -> Column:
    """A label line: class, centre and size by the picture's, six decimals."""
    c = clip(b, w, h)
    six = lambda x: F.call_function("format_number", x, F.lit("0.000000"))
    return F.concat_ws(" ", F.lit(str(label)), six((c["x_min"] + c["x_max"]) / 2 / w), six((c["y_min"] + c["y_max"]) / 2 / h), six(width(c) / w), six(height(c) / h))
