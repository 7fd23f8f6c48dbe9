"""Boxes of coloured regions in pictures that are cut into tiles.

A tile sends the strips of its border to its neighbours; with theirs around it, masks are closed and opened as if the
picture were whole, because no operation reaches further than the strips are wide. Regions are labelled within tiles;
labels that touch across a tile's edge are edges of a graph, whose components are the picture's regions. Shares of
colours in candidate boxes are counted by summed areas in each tile and added up. So no task holds more than a tile and
its surroundings, however large a picture is.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import images
from ..sources.shared import checkpoints, stored
from . import candidates
from .components import clusters

#: Side of a tile, and how far closing twice and opening once with a 5 x 7 rectangle reach.
SIZE, REACH_X, REACH_Y = 256, 12, 18
# Half sides of the rectangle; hue, saturation and value (low, high) of a price panel's reds and of white.
HALF = (2, 3)
REDS = (((0, 45, 70), (14, 255, 255)), ((165, 35, 70), (179, 255, 255)), ((4, 35, 85), (28, 235, 255)))
WHITE = ((0, 0, 135), (179, 90, 255))
#: Sum of both directions' brightness differences that makes an edge.
EDGE = 180
KNOWN, RED, WHITISH = 1, 2, 4
#: Pictures, and tiles in either direction, that a function is given at once: so many calls less, at most PICTURES * SIDE * SIDE tiles together.
PICTURES, SIDE = 16, 4
#: Tiles whose strips are sent on together.
AT_ONCE = 64
TOGETHER = ["pictures", "tiles_y", "tiles_x"]
TILE = "picture long, ty int, tx int, height int, width int, pixels binary"
TILE_COLUMNS = [c.split()[0] for c in TILE.split(", ")]
#: A tile's regions, the points of regions at its edges, and the points that they would touch beyond, as lists of equal length.
REGION = {"label": "long", "x0": "int", "y0": "int", "x1": "int", "y1": "int", "area": "long"}
OWN, ASKED = ({f"{k}_{n}": t for n, t in (("y", "int"), ("x", "int"), ("label", "long"))} for k in ("own", "asked"))
LISTS = REGION | OWN | ASKED


def spread(mask: np.ndarray, half: tuple[int, int], times: int, most: bool) -> np.ndarray:
    """Largest (or smallest) value in the rectangle around each pixel, so many times; what is outside doesn't count."""
    pick, none = (np.maximum, 0) if most else (np.minimum, 1)
    for axis, k in ((1, half[0] * times), (0, half[1] * times)):  # a rectangle twice is one of twice the reach
        pad = [(k, k) if a == axis else (0, 0) for a in (0, 1)]
        p, n = np.pad(mask, pad, constant_values=none), mask.shape[axis]
        mask = p[:, :n].copy() if axis else p[:n].copy()
        for i in range(1, 2 * k + 1):
            pick(mask, p[:, i : i + n] if axis else p[i : i + n], out=mask)
    return mask


def closed_opened(mask: np.ndarray) -> np.ndarray:
    """Gaps closed (two rounds), then specks removed (one)."""
    mask = spread(spread(mask, HALF, 2, True), HALF, 2, False)
    return spread(spread(mask, HALF, 1, False), HALF, 1, True)


@functools.lru_cache(maxsize=1)
def colour_table() -> tuple[np.ndarray, np.ndarray]:
    """What a worker knows of each colour so far: KNOWN with RED and WHITE, and brightness. Pages of colours that never come aren't touched."""
    return np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, np.uint8)


def colours(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KNOWN with RED and WHITE, and brightness, of each pixel: worked out once for each colour."""
    kind, bright = colour_table()
    code = (image[..., 0].astype(np.int32) << 16) | (image[..., 1].astype(np.int32) << 8) | image[..., 2]
    if len(new := np.unique(code[kind[code] == 0])):
        bgr = np.stack([new >> 16, new >> 8 & 255, new & 255], 1).astype(np.uint8)[:, None]
        hsv = np.rint(images.hue_saturation_value(bgr))
        hsv[:, 0] %= 180
        within = lambda lo, hi: ((hsv >= lo) & (hsv <= hi)).all(1)
        bright[new] = np.rint(images.gray(bgr))[:, 0]
        kind[new] = KNOWN + RED * np.any([within(*r) for r in REDS], 0) + WHITISH * within(*WHITE)
    return kind[code], bright[code]


def edges(bright: np.ndarray) -> np.ndarray:
    """Where brightness (with a rim of one pixel) changes much, as 0 and 1."""
    p = bright.astype(np.int16)
    dx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    dy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return (np.abs(dx) + np.abs(dy) > EDGE).astype(np.uint8)


def colour_masks(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red (closed and opened), white and edges of blue, green, red pixels, as 0 and 1."""
    kind, bright = colours(image)
    red, white = ((kind & k > 0).astype(np.uint8) for k in (RED, WHITISH))
    return closed_opened(red), white, edges(np.pad(bright, 1, mode="edge"))


def labelled(mask: np.ndarray) -> np.ndarray:
    """Number of each pixel's region (its first pixel's place, row by row), -1 outside; pixels touch at corners too."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = np.searchsorted(row, np.arange(h + 1)).tolist()
    b, e = begin.tolist(), end.tolist()
    for y in range(1, h):
        i, j = at[y - 1], at[y]
        while i < at[y] and j < at[y + 1]:
            if b[i] <= e[j] and b[j] <= e[i]:
                x, z = sorted((root(i), root(j)))
                parent[z] = x
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    out = np.full(h * w, -1, np.int64)
    first = [root(i) for i in range(len(row))]
    starts = (row * w + begin).tolist()
    for i, (y, x0, x1) in enumerate(zip(row.tolist(), b, e, strict=True)):
        out[y * w + x0 : y * w + x1] = starts[first[i]]
    return out.reshape(h, w)


def cut(picture: int, image: np.ndarray, size: int = SIZE) -> list[tuple]:
    """Rows of TILE of one picture."""
    height, width = image.shape[:2]
    return [(picture, i, k, height, width, image[i * size : (i + 1) * size, k * size : (k + 1) * size].tobytes()) for i in range(-(-height // size)) for k in range(-(-width // size))]


def tiles(pictures: DataFrame, size: int = SIZE) -> DataFrame:
    """pictures: picture, height, width, pixels (blue, green, red bytes, row by row). Their tiles; sources of larger pictures give tiles themselves."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame(cut(r.picture, np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3), size), columns=TILE_COLUMNS)

    return pictures.select("picture", "height", "width", "pixels").mapInPandas(run, TILE)


def together(df: DataFrame, picture: str) -> DataFrame:
    """df with TOGETHER: which of its tiles are looked at in one call."""
    block = lambda c, n: F.floor(F.col(c) / n).cast("long")
    return df.withColumns(dict(zip(TOGETHER, (block(picture, PICTURES), block("ty", SIDE), block("tx", SIDE)), strict=True)))


def with_masks(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """picture, ty, tx, height, width and, for each tile: red, white, edge (a byte a pixel), and LISTS."""
    if size < max(REACH_X, REACH_Y):
        raise ValueError(f"tiles must be {max(REACH_X, REACH_Y)} pixels or more")

    def strips(batches):
        for batch in (b.iloc[i : i + AT_ONCE] for b in batches for i in range(0, len(b), AT_ONCE)):
            out = []
            for r in batch.itertuples():
                h, w = min(size, r.height - r.ty * size), min(size, r.width - r.tx * size)
                kind, bright = colours(np.frombuffer(r.pixels, np.uint8).reshape(h, w, 3))
                red = kind & RED > 0
                for dy, rows, rim_y in ((-1, slice(0, REACH_Y), slice(0, 1)), (0, slice(None), slice(None)), (1, slice(-REACH_Y, None), slice(-1, None))):
                    for dx, cols, rim_x in ((-1, slice(0, REACH_X), slice(0, 1)), (0, slice(None), slice(None)), (1, slice(-REACH_X, None), slice(-1, None))):
                        if 0 <= (r.ty + dy) * size < r.height and 0 <= (r.tx + dx) * size < r.width:
                            p, white = red[rows, cols], np.packbits(kind & WHITISH > 0).tobytes() if dy == dx == 0 else b""
                            out.append((r.picture, r.ty + dy, r.tx + dx, r.height, r.width, -dy, -dx, p.shape[0], p.shape[1], np.packbits(p).tobytes(), white, bright[rim_y, rim_x].tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in piece.split(", ")])

    def whole(held: dict) -> np.ndarray:
        """A tile's part with those of its neighbours around it."""
        return np.concatenate([np.concatenate([held[dy, dx] for dx in (-1, 0, 1) if (dy, dx) in held], 1) for dy in (-1, 0, 1) if (dy, 0) in held], 0)

    def one(picture: int, ty: int, tx: int, height: int, width: int, held: dict) -> tuple:
        h, w = held[0, 0].h, held[0, 0].w
        bits = lambda x, h, w: np.unpackbits(np.frombuffer(x, np.uint8), count=h * w).reshape(h, w)
        top, left = (held[-1, 0].h if (-1, 0) in held else 0), (held[0, -1].w if (0, -1) in held else 0)
        red = closed_opened(whole({k: bits(r.red, r.h, r.w) for k, r in held.items()}))[top : top + h, left : left + w]
        rims = whole({(dy, dx): np.frombuffer(r.bright, np.uint8).reshape(1 if dy else h, 1 if dx else w) for (dy, dx), r in held.items()})
        edge = edges(np.pad(rims, [[int((d, 0) not in held) for d in (-1, 1)], [int((0, d) not in held) for d in (-1, 1)]], mode="edge"))
        white = bits(held[0, 0].white, h, w)
        y0, x0 = ty * size, tx * size
        label = labelled(red)
        ys, xs = np.nonzero(label >= 0)
        kinds, of = np.unique(label[ys, xs], return_inverse=True)
        name = lambda v: (v // w + y0) * width + v % w + x0
        ends = lambda f, v, start: f.at(out := np.full(len(kinds), start), of, v) or out
        sides = (ends(np.minimum, xs, 1 << 30) + x0, ends(np.minimum, ys, 1 << 30) + y0, ends(np.maximum, xs, -1) + x0 + 1, ends(np.maximum, ys, -1) + y0 + 1)

        def along(y: int, x: int, line: np.ndarray, down: bool) -> np.ndarray:
            """Points (y, x, label) of regions on a line of labels that begins at (y, x)."""
            at = np.flatnonzero(line >= 0)
            return np.stack([y + at * down, x + at * (not down), name(line[at])])

        # only edges behind which there are other tiles
        none = np.zeros((3, 0), np.int64)
        own = [along(y0, x0, label[0], False) if ty else none, along(y0 + bool(ty), x0, label[bool(ty) :, 0], True) if tx else none]
        right = along(y0, x0 + w - 1, label[:, -1], True) if x0 + w < width else none
        below = along(y0 + h - 1, x0, label[-1], False) if y0 + h < height else none
        asked = [p + np.array([[dy], [dx], [0]]) for p, steps in ((right, ((-1, 1), (0, 1), (1, 1))), (below, ((1, -1), (1, 0), (1, 1)))) for dy, dx in steps]
        regions = (name(kinds), *sides, np.bincount(of, minlength=len(kinds)))
        return (picture, ty, tx, height, width, red.tobytes(), white.tobytes(), edge.tobytes(), *regions, *np.concatenate(own, 1), *np.concatenate(asked, 1))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple, dict] = {}
        for r in pdf.itertuples():
            held.setdefault((r.picture, r.ty, r.tx, r.height, r.width), {})[r.dy, r.dx] = r
        return pd.DataFrame([one(*key, pieces) for key, pieces in held.items() if (0, 0) in pieces], columns=columns)

    schema = f"picture long, ty int, tx int, height int, width int, red binary, white binary, edge binary, {', '.join(f'{n} array<{t}>' for n, t in LISTS.items())}"
    columns = [c.split()[0] for c in schema.split(", ")]
    # what a tile's neighbours and itself need of it: bits of red and white, and brightness with a rim of one pixel
    piece = "picture long, ty int, tx int, height int, width int, dy int, dx int, h int, w int, red binary, white binary, bright binary"
    sent = parts.mapInPandas(strips, piece)
    # few bytes, much work: the number of tasks is given, or small partitions would be put together
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = together(sent, "picture").repartition(n, *TOGETHER)
    return sent.groupBy(*TOGETHER).applyInPandas(some, schema)


def regions(masked: DataFrame) -> DataFrame:
    """picture, height, width, box and area (pixels) of the red regions of whole pictures. masked: with_masks(), stored."""
    listed = lambda keys, names: masked.select(*keys, F.explode(F.arrays_zip(*names)).alias("p")).select(*keys, "p.*")
    own = listed(["picture"], OWN).toDF("picture", "y", "x", "label")
    asked = listed(["picture"], ASKED).toDF("picture", "y", "x", "from")
    node = lambda c: F.struct("picture", F.col(c).alias("label"))
    met = own.join(asked, ["picture", "y", "x"]).select(node("label").alias("a"), node("from").alias("b")).where("a <> b").distinct()
    found = clusters(met).select("node.picture", "node.label", F.col("cluster.label").alias("root"))
    parts = listed(["picture", "height", "width"], REGION)
    joined = parts.join(found, ["picture", "label"], "left").groupBy("picture", "height", "width", F.coalesce("root", "label").alias("label"))
    sides = joined.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))
    return sides.select("picture", "height", "width", g.box(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).alias("box"), "area")


def shares(masked: DataFrame, boxes: DataFrame, size: int = SIZE) -> DataFrame:
    """boxes (picture, ord, box: clipped) with red, white and edge: shares of the pixels in the box's whole-number sides."""
    x1, y1, x2, y2 = (F.floor(f"box.{c}").cast("int") for c in ("x_min", "y_min", "x_max", "y_max"))
    placed = boxes.select(F.col("picture").alias("of"), "ord", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).where("x2 > x1 AND y2 > y1")
    tile = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(hi) - 1) / size).cast("int")))
    placed = placed.withColumn("ty", tile("y1", "y2")).withColumn("tx", tile("x1", "x2"))

    def count(tiles: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked[["of", "ord"]].rename(columns={"of": "picture"})
        got = np.zeros((3, len(asked)), np.int64)
        at = {(r.picture, r.ty, r.tx): r for r in tiles.itertuples()}
        sides = [asked[c].to_numpy() for c in ("y1", "y2", "x1", "x2")]
        for key, i in asked.groupby(["of", "ty", "tx"]).indices.items():
            if (r := at.get(key)) is None:
                continue
            y0, x0 = r.ty * size, r.tx * size
            h, w = min(size, r.height - y0), min(size, r.width - x0)
            top, bottom, left, right = (np.clip(v[i] - o, 0, m) for v, o, m in zip(sides, (y0, y0, x0, x0), (h, h, w, w), strict=True))
            for k, c in enumerate((r.red, r.white, r.edge)):
                s = np.zeros((h + 1, w + 1), np.int64)
                np.frombuffer(c, np.uint8).reshape(h, w).cumsum(0, out=s[1:, 1:], dtype=np.int64).cumsum(1, out=s[1:, 1:])
                got[k, i] = s[bottom, right] - s[top, right] - s[bottom, left] + s[top, left]
        return out.assign(red=got[0], white=got[1], edge=got[2])

    slim = together(masked.select(*(F.col(c).alias(c) for c in ("picture", "ty", "tx", "height", "width", "red", "white", "edge"))), "picture")
    n = int(masked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    found = slim.repartition(n, *TOGETHER).groupBy(*TOGETHER).cogroup(together(placed, "of").repartition(n, *TOGETHER).groupBy(*TOGETHER)).applyInPandas(count, "picture long, ord long, red long, white long, edge long")
    summed = found.groupBy("picture", "ord").agg(*(F.sum(c).alias(c) for c in ("red", "white", "edge")))
    area = ((x2 - x1) * (y2 - y1)).cast("double")
    return boxes.join(summed, ["picture", "ord"]).withColumns({c: F.col(c) / area for c in ("red", "white", "edge")})


def tag_candidates(parts: DataFrame, size: int = SIZE, least_area: int = 80) -> DataFrame:
    """picture, box, score of candidates around the red panels of tiled pictures, by their size, shape and colours."""
    checkpoints(parts.sparkSession)
    masked = stored(with_masks(parts, size), "masks")
    panels = regions(masked).where(F.col("area") >= least_area)
    w, h = (F.col(c).cast("double") for c in ("width", "height"))
    made = panels.select("picture", "height", "width", F.explode(candidates.panel_candidates(F.col("box"))).alias("c")).select("picture", "height", "width", g.clip(F.col("c.box"), w, h).alias("box"))
    made = made.withColumn("ord", F.xxhash64("picture", "box")).dropDuplicates(["picture", "ord"])
    colours = [F.col(c) for c in ("red", "white", "edge")]
    kept = shares(masked, made, size).where(candidates.red_white_ok(F.col("box"), w, h, *colours))
    return kept.select("picture", "box", candidates.red_white_score(F.col("box"), w, h, *colours).alias("score"))
