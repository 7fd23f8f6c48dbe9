"""Registered queries: one for each operator or small family, with its SQL in DuckDB's dialect where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contrast, fields, geometry, hashes, images, likeness
from ..functions import payloads as qr
from ..functions import text as t
from ..operators import boxes, candidates, components, fusion, masks, profile, quantiles, runs, tracking
from ..sources import tables
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- sources

FRAMES = fx.OBS + ", fr AS (SELECT DISTINCT filename, frame_index, timestamp_ms, frame_index * 7 % 50 AS sharpness FROM obs)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.obs(spark, sf_dir).selectExpr("filename", "frame_index", "timestamp_ms", "frame_index * 7 % 50 AS sharpness").distinct()


@query("frames_sampled", FRAMES + "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY frame_index) AS r FROM fr WHERE frame_index % 2 = 0 AND sharpness >= 18) WHERE r <= 12")
def frames_sampled(spark, sf_dir):
    return tables.sample_frames(frames(spark, sf_dir), F.lit(5.0), 2.0, 18, 12)


@query("video_meta", FRAMES + "SELECT filename, count(*) AS frame_count, CAST(round_even(count(*) / 20.0 * 1000, 0) AS BIGINT) AS duration_ms FROM fr GROUP BY filename")
def video_meta(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("filename").agg(F.count("*").alias("frame_count"), F.rint(F.count("*") / 20.0 * 1000).cast("long").alias("duration_ms"))


@query("frame_lookup", FRAMES + """, q AS (SELECT DISTINCT 'v' || (user_id % 12) || '.mp4' AS filename, event_id * 37 % 40000 AS ts FROM events)
SELECT filename, ts, arg_min(timestamp_ms, (abs(timestamp_ms - ts), timestamp_ms)) AS frame_ts FROM q JOIN fr USING (filename) GROUP BY filename, ts""")
def frame_lookup(spark, sf_dir):
    asked = fx.read(spark, sf_dir, "events").selectExpr("concat('v', user_id % 12, '.mp4') AS filename", "event_id * 37 % 40000 AS ts").distinct()
    return tables.nearest_frame(asked, frames(spark, sf_dir))


FILES = """WITH f AS (SELECT 'd' || n_regionkey || '/' || CASE WHEN n_nationkey % 4 = 0 THEN 'd' || n_regionkey ELSE n_name END || CASE WHEN n_nationkey % 2 = 0 THEN '.mp4' ELSE '.csv' END AS path FROM nation
 UNION ALL SELECT 'd' || n_regionkey || '/' || n_name || '.csv' FROM nation WHERE n_nationkey % 3 = 0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.read(spark, sf_dir, "nation")
    a = n.selectExpr("concat('d', n_regionkey, '/', CASE WHEN n_nationkey % 4 = 0 THEN concat('d', n_regionkey) ELSE n_name END, CASE WHEN n_nationkey % 2 = 0 THEN '.mp4' ELSE '.csv' END) AS path")
    return a.unionByName(n.where("n_nationkey % 3 = 0").selectExpr("concat('d', n_regionkey, '/', n_name, '.csv') AS path")).distinct()


@query("label_pairs", FILES + """, p AS (SELECT DISTINCT path, split_part(path, '/', 1) AS dir, split_part(split_part(path, '/', 2), '.', 1) AS stem, split_part(path, '.', 2) AS kind FROM f)
SELECT c.path AS csv, coalesce(a.path, b.path) AS video FROM p c LEFT JOIN p a ON a.kind = 'mp4' AND a.dir = c.dir AND a.stem = c.stem
LEFT JOIN p b ON b.kind = 'mp4' AND b.dir = c.dir AND b.stem = c.dir WHERE c.kind = 'csv' AND coalesce(a.path, b.path) IS NOT NULL""")
def label_pairs(spark, sf_dir):
    return tables.label_pairs(files(spark, sf_dir))


@query("unlabelled_videos", FILES + """, p AS (SELECT DISTINCT path, regexp_replace(path, '\\.[a-z0-9]+$', '') AS base, path LIKE '%.mp4' AS v FROM f)
SELECT path FROM p WHERE v AND base NOT IN (SELECT base FROM p WHERE NOT v)""")
def unlabelled_videos(spark, sf_dir):
    p = files(spark, sf_dir).withColumn("base", F.regexp_replace("path", r"\.[a-z0-9]+$", ""))
    return p.where("path LIKE '%.mp4'").join(p.where("path LIKE '%.csv'"), "base", "left_anti").select("path")


@query("best_data_root", FILES + """, p AS (SELECT DISTINCT path FROM f) SELECT arg_max(dir, (n, dir)) AS root, max(n) AS n FROM (SELECT split_part(path, '/', 1) AS dir, count(*) AS n FROM p GROUP BY 1)""")
def best_data_root(spark, sf_dir):
    n = files(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("n"))
    return n.agg(F.max(F.struct("n", "dir")).alias("x")).select(F.col("x.dir").alias("root"), "x.n")


@query("newest_file", fx.OBS + "SELECT filename, arg_max(source || ord, (timestamp_ms, source || ord)) AS path, max(timestamp_ms) AS modified FROM obs GROUP BY filename")
def newest_file(spark, sf_dir):
    return tables.newest(fx.obs(spark, sf_dir).select("filename", F.col("timestamp_ms").alias("modified"), F.concat("source", "ord").alias("path")), ["filename"])


# --- rows, filters

ROUND1 = "CAST(printf('%.1f', {0}) AS DOUBLE) AS {1}"


@query("observation_rows", fx.OBS + f"SELECT ord, filename, CAST(timestamp_ms AS BIGINT) AS frame_timestamp, {ROUND1.format('x_min / 7', 'x_min')}, {ROUND1.format('y_min / 7', 'y_min')}, {ROUND1.format('x_max / 7', 'x_max')}, {ROUND1.format('y_max / 7', 'y_max')}, '' AS color, CASE WHEN cents % 2 = 0 THEN source ELSE '' END AS product_name FROM obs")
def observation_rows(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    o = o.withColumns({c: F.col(c) / 7 for c in ("x_min", "y_min", "x_max", "y_max")}).withColumn("parsed", F.when(F.col("cents") % 2 == 0, F.create_map(F.lit("product_name"), "source")).otherwise(F.create_map().cast("map<string,string>")))
    return o.select("ord", *tables.to_row(F.col("parsed"))).select("ord", "filename", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", "color", "product_name")


@query("normalised_rows", fx.TRACK_ROWS + "SELECT filename, product_name, price_default, barcode, CAST(ord AS VARCHAR) AS id_sku, '' AS code FROM tr")
def normalised_rows(spark, sf_dir):
    rows = fx.track_rows(spark, sf_dir).select("filename", "product_name", "price_default", "barcode", F.col("ord").alias("id_sku"), "cents")
    return tables.as_rows(rows).select("filename", "product_name", "price_default", "barcode", "id_sku", "code")


GATE = fx.TRACK_ROWS + """, g AS (SELECT track_id, max(CASE WHEN barcode <> '' THEN barcode END) AS barcode, max(CASE WHEN product_name NOT IN ('', 'нет', 'νες') AND track_id % 2 = 0 THEN product_name END) AS product_name,
 max(CASE WHEN track_id % 5 = 0 THEN price_default END) AS price, count(*) AS n, coalesce(list_distinct(list(source) FILTER (WHERE track_id % 7 <> 0 OR source <> 'yolo')), []) AS sources FROM tr GROUP BY track_id)"""


@query("source_gate", GATE + """SELECT track_id FROM g WHERE list_contains(sources, 'yolo') OR NOT list_has_any(sources, ['heuristic', 'red_white_tag', 'qr_seed', 'color_geometry'])
 OR coalesce(barcode, '') <> '' OR (product_name IS NOT NULL AND coalesce(price, '') <> '') OR (n >= 20 AND (product_name IS NOT NULL OR coalesce(price, '') <> ''))""")
def source_gate(spark, sf_dir):
    r = fx.track_rows(spark, sf_dir)
    g = r.groupBy("track_id").agg(
        F.max(F.when(F.col("barcode") != "", F.col("barcode"))).alias("barcode"),
        F.max(F.when(~F.col("product_name").isin("", "нет", "νες") & (F.col("track_id") % 2 == 0), F.col("product_name"))).alias("product_name"),
        F.max(F.when(F.col("track_id") % 5 == 0, F.col("price_default"))).alias("price_default"),
        F.count("*").alias("n"), F.collect_set(F.when((F.col("track_id") % 7 != 0) | (F.col("source") != "yolo"), F.col("source"))).alias("sources"),
    )
    blank = [c for c in (*fusion.MACHINE_COLUMNS, *fusion.SEMANTIC_COLUMNS) if c not in g.columns]
    g = g.withColumns({c: F.lit("") for c in (*blank, "best_text")})
    return g.where(fusion.passes_source_gate(F.col("sources"), F.col("n"), True, 20)).select("track_id")


@query("box_filters", fx.OBS + "SELECT ord FROM obs WHERE x_max - x_min > 105 AND y_max - y_min > 85 AND x_max > x_min AND y_max > y_min AND score >= 0.18")
def box_filters(spark, sf_dir):
    o = fx.with_box(fx.obs(spark, sf_dir))
    b = F.col("box")
    return o.where(geometry.valid(b) & (geometry.width(b) > 105) & (geometry.height(b) > 85) & (F.col("score") >= 0.18)).select("ord")


@query("no_evidence_rows", fx.TRACK_ROWS + "SELECT ord FROM tr WHERE lower(trim(product_name)) IN ('', 'nan', 'none', 'нет') AND price_default = '' AND barcode = ''")
def no_evidence_rows(spark, sf_dir):
    cols = ["product_name", "price_default", "barcode"]
    return fx.track_rows(spark, sf_dir).where(F.size(F.filter(F.array(*(t.filled(F.col(c)) for c in cols)), lambda x: x)) == 0).select("ord")


@query("qr_failed_rows", fx.TRACK_ROWS + "SELECT ord FROM tr WHERE product_name NOT IN ('', 'нет') AND barcode = '' ORDER BY ord LIMIT 200")
def qr_failed_rows(spark, sf_dir):
    return fx.track_rows(spark, sf_dir).where(t.filled(F.col("product_name")) & ~t.filled(F.col("barcode"))).select("ord").orderBy("ord").limit(200)


# --- boxes

FOLD = fx.OBS + """, f AS (SELECT filename, frame_index, list({{'x_min': x_min, 'y_min': y_min, 'x_max': x_max, 'y_max': y_max, 'ord': ord, 'source': source}} ORDER BY score DESC, ord) AS rows FROM obs GROUP BY filename, frame_index),
k AS (SELECT filename, frame_index, list_reduce(list_transform(rows, lambda r: [r]), lambda s, x: CASE WHEN len(list_filter(s, lambda k: {hit})) > 0 THEN s ELSE list_concat(s, x) END) AS kept FROM f)
SELECT filename, frame_index, r.ord AS ord{more} FROM (SELECT filename, frame_index, unnest(kept) AS r FROM k)"""


@query("nms", FOLD.format(hit=fx.iou_sql("x[1].", "k.") + " >= 0.38", more=", r.source AS source"))
def nms(spark, sf_dir):
    o = fx.with_box(fx.obs(spark, sf_dir)).select("filename", "frame_index", "box", "score", "ord", "source")
    return boxes.suppress(o, ["filename", "frame_index"], 0.38).select("filename", "frame_index", "ord", "source")


INTER = "greatest(0, least(x[1].x_max,k.x_max)-greatest(x[1].x_min,k.x_min)) * greatest(0, least(x[1].y_max,k.y_max)-greatest(x[1].y_min,k.y_min)) / least((x[1].x_max-x[1].x_min)*(x[1].y_max-x[1].y_min), (k.x_max-k.x_min)*(k.y_max-k.y_min))"


@query("region_suppression", FOLD.format(hit=INTER + " > 0.6", more=""))
def region_suppression(spark, sf_dir):
    o = fx.with_box(fx.obs(spark, sf_dir)).select("filename", "frame_index", "box", "score", "ord")
    return boxes.suppress(o, ["filename", "frame_index"], 0.6, geometry.containment, strict=False).select("filename", "frame_index", "ord")


@query("top_detections", fx.OBS + "SELECT filename, frame_index, ord FROM obs QUALIFY row_number() OVER (PARTITION BY filename, frame_index ORDER BY score DESC, ord) <= 5")
def top_detections(spark, sf_dir):
    w = Window.partitionBy("filename", "frame_index").orderBy(F.desc("score"), "ord")
    return fx.obs(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 5").select("filename", "frame_index", "ord")


@query("greedy_match")
def greedy_match(spark, sf_dir):
    return boxes.greedy_match(fx.with_box(fx.truth(spark, sf_dir)), fx.with_box(fx.predicted(spark, sf_dir)), "frame").select("frame", "gt_ord", "pred_ord", F.round("iou", 4).alias("iou"))


@query("unmatched_truth")
def unmatched_truth(spark, sf_dir):
    gt = fx.with_box(fx.truth(spark, sf_dir))
    met = boxes.greedy_match(gt, fx.with_box(fx.predicted(spark, sf_dir)), "frame")
    return gt.select("ord").join(met.select(F.col("gt_ord").alias("ord")), "ord", "left_anti")


BEST = fx.TRUTH + f""", best AS (SELECT g.filename, g.frame_index, g.ord, coalesce(max({fx.iou_sql('g.', 'p.')}), 0) AS best_iou, count(p.ord) AS n_pred
 FROM gt g LEFT JOIN pred p ON g.filename = p.filename AND g.frame_index = p.frame_index GROUP BY g.filename, g.frame_index, g.ord)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = fx.with_box(fx.truth(spark, sf_dir)).select("filename", "frame_index", "ord", "box")
    return boxes.best_overlap(gt, fx.with_box(fx.predicted(spark, sf_dir)), ["filename", "frame_index"])


@query("detector_recall", BEST + """SELECT coalesce(filename, 'TOTAL') AS video, count(*) FILTER (WHERE best_iou >= 0.35) AS matched, count(*) AS total, round(count(*) FILTER (WHERE best_iou >= 0.35) / count(*), 6) AS recall FROM best GROUP BY ROLLUP (filename)""")
def detector_recall(spark, sf_dir):
    hit = F.count_if(F.col("best_iou") >= 0.35)
    return overlaps(spark, sf_dir).rollup("filename").agg(hit.alias("matched"), F.count("*").alias("total"), F.round(hit / F.count("*"), 6).alias("recall")).select(F.coalesce("filename", F.lit("TOTAL")).alias("video"), "matched", "total", "recall")


@query("detector_misses", BEST + "SELECT ord, round(best_iou, 4) AS best_iou, n_pred FROM best WHERE best_iou < 0.35")
def detector_misses(spark, sf_dir):
    return overlaps(spark, sf_dir).where("best_iou < 0.35").select("ord", F.round("best_iou", 4).alias("best_iou"), "n_pred")


@query("time_band_join", FRAMES + "SELECT o.ord, f.frame_index FROM obs o JOIN fr f ON o.filename = f.filename AND abs(o.timestamp_ms + o.cents % 700 - f.timestamp_ms) < 550")
def time_band_join(spark, sf_dir):
    o = fx.obs(spark, sf_dir).selectExpr("ord", "filename", "timestamp_ms + cents % 700 AS ta")
    f = frames(spark, sf_dir).select("filename", "frame_index", F.col("timestamp_ms").alias("tb"))
    return boxes.band_pairs(o, f, "filename", "ta", "tb", 550, True).select("ord", "frame_index")


def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.track_rows(spark, sf_dir)
    return r.select("ord", "filename", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", "product_name", "price_default", F.lit("").alias("price_card"), "barcode", F.lit("").alias("qr_code_barcode"), F.lit("").alias("id_sku"), F.lit("").alias("code"), F.col("text").alias("best_text"), F.lower(F.lpad(F.hex(F.col("cents") * 2654435761), 16, "0")).alias("visual_hash"))


@query("duplicate_pairs")
def duplicate_pairs(spark, sf_dir):
    return fusion.duplicate_pairs(dedupe_rows(spark, sf_dir))


@query("duplicate_pairs_by_words")
def duplicate_pairs_by_words(spark, sf_dir):
    return fusion.duplicate_pairs(dedupe_rows(spark, sf_dir), kind="token_set")


@query("row_groups")
def row_groups(spark, sf_dir):
    rows = dedupe_rows(spark, sf_dir)
    return fusion.group_rows(rows, fusion.duplicate_pairs(rows, grouping=True)).select("ord", "filename", "group_key")


EDGES = fx.OBS + f", ed AS (SELECT a.ord AS a, b.ord AS b FROM obs a JOIN obs b ON a.filename = b.filename AND a.frame_index = b.frame_index AND a.ord < b.ord AND {fx.iou_sql('a.', 'b.')} >= 0.5)"


@query("duplicate_clusters", EDGES.replace("WITH e0", "WITH RECURSIVE e0") + """, un AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), r(node, root) AS (SELECT a, a FROM un UNION SELECT un.b, r.root FROM r JOIN un ON un.a = r.node WHERE r.root <> un.b)
SELECT node, min(least(root, node)) AS cluster FROM r GROUP BY node""")
def duplicate_clusters(spark, sf_dir):
    o = fx.with_box(fx.obs(spark, sf_dir)).select("filename", "frame_index", "ord", "box")
    # equal boxes that overlap themselves are linked to the first of them, which meets the others for all
    first = Window.partitionBy("filename", "frame_index", "box")
    o = o.withColumn("a", F.when(geometry.area(F.col("box")) > 0, F.min("ord").over(first)).otherwise(F.col("ord")))
    a, b = (o.where("a = ord").select("filename", "frame_index", F.col("ord").alias(x), F.col("box").alias("b" + x)) for x in "ab")
    met = boxes.meeting(a, b, ["filename", "frame_index"], "ba", "bb").where("a < b").where(geometry.iou(F.col("ba"), F.col("bb")) >= 0.5)
    met = met.select("a", "b").unionByName(o.where("a < ord").select("a", F.col("ord").alias("b")))
    return components.clusters(met.select("a", "b"))


@query("geometry", fx.OBS + f"""SELECT ord, round({fx.iou_sql('obs.', 'q.')}, 9) AS iou, round(sqrt(pow((obs.x_min + obs.x_max) / 2 - 250, 2) + pow((obs.y_min + obs.y_max) / 2 - 145, 2)), 9) AS distance, greatest(0, least(obs.x_min, 299.0)) AS clipped, (obs.x_max - obs.x_min) * (obs.y_max - obs.y_min) AS area
 FROM obs, (SELECT 200.0::DOUBLE AS x_min, 110.0::DOUBLE AS y_min, 300.0::DOUBLE AS x_max, 180.0::DOUBLE AS y_max) q""")
def geometry_query(spark, sf_dir):
    q = geometry.box(*(F.lit(v) for v in (200.0, 110.0, 300.0, 180.0)))
    b = F.col("box")
    clipped = geometry.clip(b, F.lit(300.0), F.lit(200.0))["x_min"]
    return fx.with_box(fx.obs(spark, sf_dir)).select("ord", F.round(geometry.iou(b, q), 9).alias("iou"), F.round(geometry.distance(b, q), 9).alias("distance"), clipped.alias("clipped"), geometry.area(b).alias("area"))


@query("yolo_labels", fx.OBS + """SELECT ord, '0 ' || printf('%.6f', (x_min + x_max) / 2 / 4000) || ' ' || printf('%.6f', (y_min + y_max) / 2 / 2160) || ' ' || printf('%.6f', (x_max - x_min) / 4000) || ' ' || printf('%.6f', (y_max - y_min) / 2160) AS line FROM obs WHERE x_max < 3999""")
def yolo_labels(spark, sf_dir):
    return fx.with_box(fx.obs(spark, sf_dir)).where("box.x_max < 3999").select("ord", geometry.yolo_line(F.col("box"), F.lit(4000.0), F.lit(2160.0)).alias("line"))


@query("candidate_boxes", fx.OBS + "SELECT ord, k, round(x_min - (x_max - x_min) * (0.1 * k), 6) AS x_min, round(x_max + (x_max - x_min) * (0.1 * k), 6) AS x_max FROM obs, range(1, 9) t(k)")
def candidate_boxes(spark, sf_dir):
    o = fx.obs(spark, sf_dir).select("ord", "x_min", "x_max", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("k"))
    w = F.col("x_max") - F.col("x_min")
    return o.select("ord", "k", F.round(F.col("x_min") - w * (0.1 * F.col("k")), 6).alias("x_min"), F.round(F.col("x_max") + w * (0.1 * F.col("k")), 6).alias("x_max"))


# --- fusion and aggregates


@query("merged_fields", fx.TRACK_ROWS + """, v AS (SELECT track_id, CASE WHEN product_name IN ('нет', 'νες') THEN 'нет' ELSE product_name END AS v, ord FROM tr),
c AS (SELECT track_id, v, count(*) AS n, min(ord) AS o FROM v WHERE v <> '' GROUP BY track_id, v)
SELECT track_id, arg_max(v, (n, v <> 'нет', length(v), -o)) AS product_name FROM c GROUP BY track_id""")
def merged_fields(spark, sf_dir):
    return fusion.merge_values(fx.track_rows(spark, sf_dir), ["track_id"], "product_name", "ord")


@query("fused_tracks", fx.TRACK_ROWS + """, v AS (SELECT track_id, 'product_name' AS c, CASE WHEN product_name = 'νες' THEN 'нет' ELSE product_name END AS v, ord FROM tr UNION ALL SELECT track_id, 'price_default', price_default, ord FROM tr UNION ALL SELECT track_id, 'barcode', barcode, ord FROM tr),
n AS (SELECT track_id, c, v, count(*) AS n, min(ord) AS o FROM v WHERE v <> '' GROUP BY ALL), b AS (SELECT track_id, c, arg_max(v, (n, v <> 'нет', length(v), -o)) AS v FROM n GROUP BY ALL)
SELECT track_id, max(v) FILTER (WHERE c = 'product_name') AS product_name, max(v) FILTER (WHERE c = 'price_default') AS price_default, max(v) FILTER (WHERE c = 'barcode') AS barcode FROM b GROUP BY track_id""")
def fused_tracks(spark, sf_dir):
    return fusion.merge_fields(fx.track_rows(spark, sf_dir), ["track_id"], ["product_name", "price_default", "barcode"], "ord")


@query("track_stats", fx.TRACK_ROWS + "SELECT track_id, count(*) AS observations, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources FROM tr GROUP BY track_id HAVING count(*) >= 2")
def track_stats(spark, sf_dir):
    g = fx.track_rows(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("observations"), F.min("timestamp_ms").alias("first_ts"), F.max("timestamp_ms").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    return g.where("observations >= 2")


REP = fx.TRACK_ROWS + """, st AS (SELECT track_id, quantile_cont(timestamp_ms, 0.5) AS med, greatest(1000.0, max(timestamp_ms) - min(timestamp_ms)) AS span FROM tr GROUP BY track_id),
sc AS (SELECT tr.*, CASE WHEN has_qr THEN 100.0 ELSE 0.0 END + least(40.0, length(text) * CAST(0.2 AS DOUBLE)) + least(8.0, ln(1 + quality) * CAST(0.8 AS DOUBLE)) + least(6.0, (x_max - x_min) * (y_max - y_min) / CAST(40000 AS DOUBLE)) + score * CAST(6.0 AS DOUBLE)
 - CASE WHEN NOT has_qr AND text = '' THEN abs(timestamp_ms - med) / span * 8 ELSE 0.0 END AS s FROM tr JOIN st USING (track_id))
"""


@query("representatives", REP + "SELECT track_id, ord FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(s, 9) DESC, ord) = 1")
def representatives(spark, sf_dir):
    rows = fx.with_box(fx.track_rows(spark, sf_dir))
    return fusion.representatives(rows, ["track_id"], 8.0).select("track_id", "ord")


SHORT = REP.replace("FROM tr GROUP BY track_id)", "FROM ts GROUP BY track_id)").replace(", st AS (", ", ts AS (SELECT * REPLACE (ord // 2 AS track_id) FROM tr), st AS (").replace("sc AS (SELECT tr.*,", "sc AS (SELECT ts.*,").replace("FROM tr JOIN st", "FROM ts JOIN st")


@query("deferred_enrichment", SHORT + ", r AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(s, 9) DESC, ord) = 1) SELECT r.track_id, r.ord, count(o.ord) AS in_frame FROM r JOIN obs o ON o.filename = r.filename AND o.timestamp_ms = r.timestamp_ms WHERE NOT r.has_qr AND r.text = '' GROUP BY r.track_id, r.ord")
def deferred_enrichment(spark, sf_dir):
    short = fx.track_rows(spark, sf_dir).withColumn("track_id", F.expr("ord div 2"))
    rep = fusion.representatives(fx.with_box(short), ["track_id"], 8.0).where("size(payloads) = 0 AND text = ''").select("track_id", "ord", "filename", "timestamp_ms")
    found = fx.obs(spark, sf_dir).groupBy("filename", "timestamp_ms").agg(F.count("*").alias("in_frame"))
    return rep.join(found, ["filename", "timestamp_ms"]).select("track_id", "ord", "in_frame")


@query("stable_keys", fx.TRACK_ROWS + "SELECT filename, CASE WHEN barcode <> '' THEN 'barcode:' || barcode ELSE '' END AS key, count(*) AS n FROM tr GROUP BY ALL")
def stable_keys(spark, sf_dir):
    r = fx.track_rows(spark, sf_dir).withColumns({c: F.lit("нет") for c in ("qr_code_barcode", "id_sku", "code")})
    return r.groupBy("filename", fusion.stable_key().alias("key")).agg(F.count("*").alias("n"))


@query("tags_per_video", fx.OBS + "SELECT filename, count(*) AS tags, count(DISTINCT timestamp_ms) AS times FROM obs GROUP BY filename")
def tags_per_video(spark, sf_dir):
    return fx.obs(spark, sf_dir).groupBy("filename").agg(F.count("*").alias("tags"), F.countDistinct("timestamp_ms").alias("times"))


def described_sql(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS name, round(min({expr}), 3) AS min, round(quantile_cont({expr}, 0.1), 3) AS p10, round(quantile_cont({expr}, 0.5), 3) AS p50, round(quantile_cont({expr}, 0.9), 3) AS p90, round(max({expr}), 3) AS max, round(avg({expr}), 3) AS mean FROM obs"


@query("box_profile", fx.OBS + " UNION ALL ".join(described_sql(*x) for x in (("width", "(x_max - x_min)"), ("height", "(y_max - y_min)"), ("area", "((x_max - x_min) * (y_max - y_min))"), ("aspect", "((x_max - x_min) / greatest(y_max - y_min, 1e-6))"))))
def box_profile(spark, sf_dir):
    o = fx.obs(spark, sf_dir).selectExpr("x_max - x_min AS width", "y_max - y_min AS height", "(x_max - x_min) * (y_max - y_min) AS area", "(x_max - x_min) / greatest(y_max - y_min, 1e-6) AS aspect")
    return profile.describe(o, ["width", "height", "area", "aspect"])


@query("fill_rates", fx.TRACK_ROWS + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg(CASE WHEN trim({c}) NOT IN ('', 'нет') THEN 1.0 ELSE 0.0 END), 4) AS rate FROM tr" for c in ("product_name", "price_default", "barcode")))
def fill_rates(spark, sf_dir):
    return profile.fill_rate(fx.track_rows(spark, sf_dir), ["product_name", "price_default", "barcode"])


@query("field_fill", fx.TRACK_ROWS + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE trim({c}) NOT IN ('', 'нет')) AS n FROM tr" for c in ("product_name", "price_default", "barcode")))
def field_fill(spark, sf_dir):
    return profile.fill_counts(fx.track_rows(spark, sf_dir).withColumn("code", F.lit("")), ["product_name", "price_default", "barcode", "code"])


@query("evaluation_summary")
def evaluation_summary(spark, sf_dir):
    def filled(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit("") for c in profile.COMPARED_COLUMNS}).withColumn("product_name", F.concat(F.lit("Сыр "), F.col("cents") % 3))

    gt, pred = fx.truth(spark, sf_dir), fx.predicted(spark, sf_dir)
    met = boxes.greedy_match(fx.with_box(gt), fx.with_box(pred), "frame")
    return profile.evaluate(filled(gt), filled(pred), met)


@query("row_similarity", fx.TRUTH + f"""SELECT g.ord, round(0.85 * ((CASE WHEN g.cents % 3 = p.cents % 4 THEN 1.0 WHEN 0.5 >= 0.65 THEN 0.75 ELSE 0.0 END)
 + (CASE WHEN g.source = p.source THEN 1.0 ELSE 0.0 END)) / 2 + 0.15 * {fx.iou_sql('g.', 'p.')}, 9) AS similarity FROM gt g JOIN pred p ON p.ord = g.ord * 2""")
def row_similarity(spark, sf_dir):
    blank = {c: F.lit("") for c in profile.COMPARED_COLUMNS}
    gt = fx.truth(spark, sf_dir).withColumns(blank).withColumns({"product_name": F.concat(F.lit("Сыр "), F.col("cents") % 3), "color": F.col("source")})
    pred = fx.predicted(spark, sf_dir).withColumns(blank).withColumns({"product_name": F.concat(F.lit("сыр "), F.col("cents") % 4), "color": F.upper("source")})
    return gt.alias("g").join(pred.alias("p"), F.col("p.ord") == F.col("g.ord") * 2).select("g.ord", F.round(profile.row_similarity("g", "p"), 9).alias("similarity"))


@query("frame_totals", fx.OBS + "SELECT coalesce(filename, 'TOTAL') AS video, count(*) AS boxes, count(DISTINCT frame_index) AS frames FROM obs WHERE score >= 0.65 GROUP BY ROLLUP (filename)")
def frame_totals(spark, sf_dir):
    return fx.obs(spark, sf_dir).where("score >= 0.65").rollup("filename").agg(F.count("*").alias("boxes"), F.countDistinct("frame_index").alias("frames")).select(F.coalesce("filename", F.lit("TOTAL")).alias("video"), "boxes", "frames")


RUNS = fx.OBS + ", run AS (SELECT 'run' || (cents % 4) AS run, filename AS video, count(*) AS gt, count(*) FILTER (WHERE cents % 5 < 4) + count(*) FILTER (WHERE cents % 4 = 0) AS pred, count(*) FILTER (WHERE cents % 3 > 0) AS matched, count(*) FILTER (WHERE cents % 6 = 1) AS good FROM obs GROUP BY ALL)"


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.obs(spark, sf_dir)
    return o.groupBy(F.concat(F.lit("run"), F.col("cents") % 4).alias("run"), F.col("filename").alias("video")).agg(F.count("*").alias("gt"), (F.count_if(F.col("cents") % 5 < 4) + F.count_if(F.col("cents") % 4 == 0)).alias("pred"), F.count_if(F.col("cents") % 3 > 0).alias("matched"), F.count_if(F.col("cents") % 6 == 1).alias("good"))


@query("run_comparison", RUNS + """SELECT run, CAST(sum(gt) AS BIGINT) AS gt_total, CAST(sum(pred) AS BIGINT) AS pred_total, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(good) AS BIGINT) AS good80, sum(pred) > 1.35 * sum(gt) AS exploded,
 CAST(coalesce(sum(pred) FILTER (WHERE video = 'v0.mp4'), 0) AS BIGINT) AS v0_pred, CAST(coalesce(sum(matched) FILTER (WHERE video = 'v1.mp4'), 0) AS BIGINT) AS v1_matched FROM run GROUP BY run""")
def run_comparison(spark, sf_dir):
    m = run_metrics(spark, sf_dir)
    total = m.groupBy("run").agg(F.sum("gt").alias("gt_total"), F.sum("pred").alias("pred_total"), F.sum("matched").alias("matched"), F.sum("good").alias("good80")).withColumn("exploded", F.col("pred_total") > 1.35 * F.col("gt_total"))
    wide = m.groupBy("run").pivot("video", ["v0.mp4", "v1.mp4"]).agg(F.sum("pred").alias("pred"), F.sum("matched").alias("matched")).na.fill(0)
    out = total.join(wide, "run", "left").select("run", "gt_total", "pred_total", "matched", "good80", "exploded", F.col("`v0.mp4_pred`").alias("v0_pred"), F.col("`v1.mp4_matched`").alias("v1_matched"))
    return out.orderBy(F.desc("good80"), F.desc("matched"))


@query("ocr_lines", fx.OBS + """SELECT filename, frame_index, cents % 3 AS line, string_agg(source, ' ' ORDER BY ord) AS text, round(avg(score), 9) AS confidence, min(x_min) AS x_min, max(x_max) AS x_max
 FROM obs WHERE score >= 0.05 GROUP BY filename, frame_index, cents % 3 HAVING length(string_agg(source, ' ')) >= 2""")
def ocr_lines(spark, sf_dir):
    o = fx.obs(spark, sf_dir).where("score >= 0.05").withColumn("line", F.col("cents") % 3)
    g = o.groupBy("filename", "frame_index", "line").agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("w"), F.round(F.avg("score"), 9).alias("confidence"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"))
    return g.withColumn("text", F.array_join("w.source", " ")).where("length(text) >= 2").drop("w")


@query("keep_first_lines", fx.OBS + "SELECT filename, frame_index, source AS key, ord FROM obs QUALIFY row_number() OVER (PARTITION BY filename, frame_index, source ORDER BY score DESC, ord) = 1")
def keep_first_lines(spark, sf_dir):
    o = fx.obs(spark, sf_dir).withColumn("key", F.regexp_replace(F.lower(F.concat(F.lit(" "), "source", F.lit("!"))), r"(?U)\W+", ""))
    w = Window.partitionBy("filename", "frame_index", "key").orderBy(F.desc("score"), "ord")
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").select("filename", "frame_index", "key", "ord")


@query("trajectories", fx.TRACK_ROWS + "SELECT track_id, array_to_string(list(timestamp_ms || ':' || ord ORDER BY timestamp_ms, ord), ',') AS path FROM tr GROUP BY track_id")
def trajectories(spark, sf_dir):
    g = fx.track_rows(spark, sf_dir).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("timestamp_ms", "ord"))).alias("x"))
    return g.select("track_id", F.array_join(F.transform("x", lambda o: F.concat_ws(":", o["timestamp_ms"].cast("string"), o["ord"].cast("string"))), ",").alias("path"))


@query("track_debug", fx.TRACK_ROWS + "SELECT track_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS engines, max(text) AS text FROM tr GROUP BY track_id")
def track_debug(spark, sf_dir):
    return fx.track_rows(spark, sf_dir).groupBy("track_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("engines"), F.max("text").alias("text"))


@query("median_time_and_span", fx.TRACK_ROWS + "SELECT track_id, quantile_cont(timestamp_ms, 0.5) AS median, greatest(1000.0, max(timestamp_ms) - min(timestamp_ms))::DOUBLE AS span FROM tr GROUP BY track_id")
def median_time_and_span(spark, sf_dir):
    rows = fx.track_rows(spark, sf_dir)
    span = rows.groupBy("track_id").agg(F.greatest(F.lit(1000.0), (F.max("timestamp_ms") - F.min("timestamp_ms")).cast("double")).alias("span"))
    return quantiles.quantile_columns(rows, ["track_id"], "timestamp_ms", {"median": 0.5}).join(span, "track_id")


@query("id_sets", fx.TRACK_ROWS + "SELECT track_id, coalesce(array_to_string(list_sort(list_distinct(list(barcode) FILTER (WHERE barcode <> ''))), ','), '') AS ids FROM tr GROUP BY track_id")
def id_sets(spark, sf_dir):
    return fx.track_rows(spark, sf_dir).groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("barcode") != "", F.col("barcode")))), ",").alias("ids"))


@query("hue_mode", fx.OBS + ", h AS (SELECT filename, cents % 180 // 10 AS bin, count(*) AS n FROM obs GROUP BY ALL) SELECT filename, arg_max(bin, (n, -bin)) * 10 + 5 AS hue FROM h GROUP BY filename")
def hue_mode(spark, sf_dir):
    h = fx.obs(spark, sf_dir).groupBy("filename", F.expr("cents % 180 div 10").alias("bin")).agg(F.count("*").alias("n"))
    return h.groupBy("filename").agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("x")).select("filename", (-F.col("x.m") * 10 + 5).alias("hue"))


@query("module_boxes", fx.OBS + "SELECT filename, frame_index, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM obs WHERE x_max - x_min < 115 GROUP BY filename, frame_index HAVING count(*) >= 6")
def module_boxes(spark, sf_dir):
    return fx.obs(spark, sf_dir).where("x_max - x_min < 115").groupBy("filename", "frame_index").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"), F.count("*").alias("n")).where("n >= 6").drop("n")


@query("background_level", fx.OBS + "SELECT filename, round(quantile_cont(CAST(cents % 256 AS DOUBLE), 0.88), 6) AS level FROM obs GROUP BY filename")
def background_level(spark, sf_dir):
    rows = fx.obs(spark, sf_dir).select("filename", (F.col("cents") % 256).alias("level"))
    return quantiles.quantile_columns(rows, ["filename"], "level", {"level": 0.88}).withColumn("level", F.round("level", 6))


@query("area_sample", fx.OBS + """, n AS (SELECT filename, ord, row_number() OVER (PARTITION BY filename ORDER BY (x_max - x_min) * (y_max - y_min), ord) - 1 AS i, count(*) OVER (PARTITION BY filename) AS n FROM obs)
SELECT filename, ord FROM n WHERE list_contains(list_transform(range(0, 24), lambda k: CAST(floor(k * (n - 1) / 23) AS BIGINT)), i)""")
def area_sample(spark, sf_dir):
    o = fx.obs(spark, sf_dir).withColumn("area", F.expr("(x_max - x_min) * (y_max - y_min)"))
    return profile.evenly_spaced(o, "area", "ord", 24, ["filename"]).select("filename", "ord")


@query("propagation_prefix", fx.TRACK_ROWS + "SELECT track_id, ord FROM (SELECT track_id, ord, min(CASE WHEN score >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY timestamp_ms, ord) AS ok FROM tr) WHERE ok = 1")
def propagation_prefix(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("timestamp_ms", "ord")
    return fx.track_rows(spark, sf_dir).withColumn("ok", F.min(F.when(F.col("score") >= 0.1, 1).otherwise(0)).over(w)).where("ok = 1").select("track_id", "ord")


@query("row_numbers", fx.OBS + "SELECT filename, ord, row_number() OVER (PARTITION BY filename ORDER BY timestamp_ms, y_min, x_min, ord) AS id FROM obs")
def row_numbers(spark, sf_dir):
    w = Window.partitionBy("filename").orderBy("timestamp_ms", "y_min", "x_min", "ord")
    return fx.obs(spark, sf_dir).select("filename", "ord", F.row_number().over(w).cast("long").alias("id"))


@query("circuit_breaker", fx.OBS + "SELECT ord, source FROM (SELECT ord, source, coalesce(sum(CASE WHEN cents % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM obs) WHERE failed < 3")
def circuit_breaker(spark, sf_dir):
    before = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum(F.when(F.col("cents") % 97 == 0, 1).otherwise(0)).over(before), F.lit(0))
    return fx.obs(spark, sf_dir).withColumn("failed", failed).where("failed < 3").select("ord", "source")


@query("source_union", fx.OBS + "SELECT ord, 'full' AS zone, score AS confidence FROM obs WHERE source = 'yolo' UNION ALL SELECT ord, 'zone', score * 0.97 FROM obs WHERE source <> 'yolo'")
def source_union(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    return o.where("source = 'yolo'").select("ord", F.lit("full").alias("zone"), F.col("score").alias("confidence")).unionByName(o.where("source <> 'yolo'").select("ord", F.lit("zone").alias("zone"), (F.col("score") * F.lit(0.97)).alias("confidence")))


# --- tracker


@query("tracks")
def tracks(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    last = o.groupBy("filename").agg(F.max("frame_index").alias("n"))
    every = last.select("filename", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("frame_index"))
    return tracking.track(every, o)


@query("lost_counters", fx.TRACK_ROWS + """, fr AS (SELECT filename, frame_index, row_number() OVER (PARTITION BY filename ORDER BY frame_index) AS seq FROM (SELECT DISTINCT filename, frame_index FROM obs)),
a AS (SELECT filename, track_id, frame_index, min(ord) AS ord FROM tr GROUP BY ALL) SELECT a.filename, track_id, ord, coalesce(seq - lag(seq) OVER (PARTITION BY a.filename, track_id ORDER BY seq) - 1, 0) AS missed FROM a JOIN fr USING (filename, frame_index)""")
def lost_counters(spark, sf_dir):
    a = fx.track_rows(spark, sf_dir).groupBy("filename", "track_id", "frame_index").agg(F.min("ord").alias("ord"))
    return tracking.lost_before(frames(spark, sf_dir), a)


# --- text


@query("normalised_text", """SELECT page_id, trim(regexp_replace(replace(url, chr(160), ' '), '\\s+', ' ', 'g')) AS norm, trim(regexp_replace(lower(replace(url, 'ё', 'е')), '[^0-9a-zа-я]+', ' ', 'g')) AS alike FROM pages""")
def normalised_text(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", t.normalize_text(F.col("url")).alias("norm"), t.normalize_for_similarity(F.col("url")).alias("alike"))


@query("price_strings", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN ' ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ',5 ₽' WHEN 1 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' 00.25' ELSE 'нет цены' END AS raw FROM lineitem),
m AS (SELECT *, regexp_extract(replace(replace(replace(trim(raw), ' ', ''), '₽', ''), ',', '.'), '([0-9]{1,5})(\\.([0-9]{1,2}))?', ['w', 'x', 'f']) AS g FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN g.w <> '' THEN CAST(TRY_CAST(g.w AS INTEGER) AS VARCHAR) || '.' || rpad(g.f, 2, '0') ELSE trim(raw) END AS price FROM m""")
def price_strings(spark, sf_dir):
    raw = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat(' ', cast(floor(l_extendedprice) AS bigint), ',5 ₽') WHEN 1 THEN concat(cast(floor(l_quantity) AS bigint), ' 00.25') ELSE 'нет цены' END")
    return fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.price_to_str(raw).alias("price"))


@query("smart_numbers", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey + 0.5 WHEN 1 THEN CAST(p_partkey AS DOUBLE) ELSE NULL END AS num, CAST(CASE p_partkey % 3 WHEN 0 THEN round_even(p_partkey + 0.5, 0) WHEN 1 THEN p_partkey ELSE 0 END AS BIGINT) AS whole FROM part")
def smart_numbers(spark, sf_dir):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_partkey, ',5') WHEN 1 THEN concat('№ ', p_partkey, ' шт') ELSE 'нет' END")
    num = t.smart_float(raw)
    return fx.read(spark, sf_dir, "part").select("p_partkey", F.when(~F.isnan(num), num).alias("num"), t.smart_int(raw).alias("whole"))


@query("ean_codes", """WITH c AS (SELECT p_partkey, '46' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS code FROM part)
SELECT p_partkey, (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(code[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10 = CAST(code[13] AS INTEGER) AS valid FROM c""")
def ean_codes(spark, sf_dir):
    return fx.read(spark, sf_dir, "part").select("p_partkey", t.ean13_is_valid(F.expr("concat('46', lpad(p_partkey, 11, '0'))")).alias("valid"))


@query("found_prices")
def found_prices(spark, sf_dir):
    return fx.tag_text(spark, sf_dir).select("ord", F.array_join(t.find_prices_in_lines(F.col("lines"), F.array_join("lines", "\n")), ";").alias("prices"))


@query("tag_scalars", fx.TAG_TEXT + """SELECT ord, CASE WHEN ord % 4 = 0 THEN 'нет' ELSE '-' || (ord % 90) || '%' END AS discount_amount,
 lpad(CAST(ord % 28 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ord % 12 + 1 AS VARCHAR), 2, '0') || '.2026 ' || (ord % 24) || ':' || lpad(CAST(ord % 60 AS VARCHAR), 2, '0') AS print_datetime,
 CASE WHEN ord % 2 = 0 THEN replace(lines[5], ' ', '') ELSE 'нет' END AS code, CASE WHEN ord % 2 = 1 THEN 'Ш' ELSE 'нет' END AS special_symbols, CASE WHEN ord % 5 = 0 THEN 'сухое' ELSE 'нет' END AS additional_info FROM tag""")
def tag_scalars(spark, sf_dir):
    row = fields.parse_observation(F.col("lines"), F.array().cast("array<string>"))
    return fx.tag_text(spark, sf_dir).select("ord", row.alias("r")).select("ord", "r.*").select("ord", "discount_amount", "print_datetime", "code", "special_symbols", "additional_info")


@query("parsed_tags")
def parsed_tags(spark, sf_dir):
    row = fields.parse_observation(F.col("lines"), F.array(F.concat(F.lit("b=46"), F.lpad("ord", 11, "0"), F.lit("&p4=12,5"))))
    return fx.tag_text(spark, sf_dir).select("ord", row.alias("r")).select("ord", "r.*")


PAYLOAD_FIELDS = """SELECT ord, CASE dialect WHEN 1 THEN gtin ELSE code END AS qr_code_barcode, CASE WHEN dialect IN (2, 3) THEN price ELSE '' END AS price1_qr, CASE WHEN dialect = 5 THEN (c // 100) || '.25' ELSE '' END AS price2_qr,
 CASE WHEN dialect = 4 THEN (c // 100) || '.50' ELSE '' END AS price4_qr, CASE WHEN dialect = 3 THEN 'A ' || (ord % 9) ELSE '' END AS action_code_qr FROM pay"""


@query("payload_fields", fx.PAYLOADS + PAYLOAD_FIELDS)
def payload_fields(spark, sf_dir):
    m = fx.dealt(fx.payloads(spark, sf_dir), "ord").select("ord", qr.parse_payload(F.col("payload")).alias("m"))
    return m.select("ord", *(F.coalesce(F.element_at("m", c), F.lit("")).alias(c) for c in ("qr_code_barcode", "price1_qr", "price2_qr", "price4_qr", "action_code_qr")))


@query("merged_payloads", fx.PAYLOADS + f", pf AS ({PAYLOAD_FIELDS}) SELECT ord // 4 AS g, bool_or(ord % 6 IN (0, 3)) AS structured, " + ", ".join(f"coalesce(arg_min({c}, ord) FILTER ({c} <> ''), 'нет') AS {c}" for c in ("qr_code_barcode", "price1_qr", "price4_qr", "action_code_qr")) + " FROM pf GROUP BY ALL")
def merged_payloads(spark, sf_dir):
    rows = fx.payloads(spark, sf_dir).withColumn("g", F.expr("ord div 4"))
    p = fx.dealt(rows, "g").groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "payload"))), lambda x: x["payload"]).alias("ps"))
    p = p.select("g", qr.is_structured(F.col("ps")).alias("structured"), qr.with_absent(qr.parse_payloads(F.col("ps")), F.col("ps")).alias("m"))
    return p.select("g", "structured", *(F.element_at("m", c).alias(c) for c in ("qr_code_barcode", "price1_qr", "price4_qr", "action_code_qr")))


@query("text_likeness")
def text_likeness(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part").select("p_partkey", t.normalize_for_similarity(F.col("p_name")).alias("a"), t.normalize_for_similarity(F.col("p_type")).alias("b"))
    return p.select("p_partkey", F.round(likeness.similarity()("a", "b"), 9).alias("likeness"))


@query("token_likeness")
def token_likeness(spark, sf_dir):
    """Likeness by words of each part's name with its neighbour's, and with its own in another order and shortened."""
    p = fx.read(spark, sf_dir, "part").select("p_partkey", t.normalize_for_similarity(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("a"))
    near = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    own = F.array_join(F.slice(F.reverse(F.split("a", " ")), 1, 3), " ")
    alike = likeness.similarity("token_set")
    return p.join(near, "p_partkey").select("p_partkey", F.round(alike("a", "b"), 9).alias("likeness"), F.round(alike("a", own), 9).alias("to_own"))


# --- hashes and pixels


@query("gradient_hashes", """WITH e AS (SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN i % 8 < 7 AND embedding[i + 2] > embedding[i + 1] THEN '1' WHEN i % 8 < 7 THEN '0' ELSE '' END) AS b FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(1, 57), lambda i: CASE WHEN array_to_string(b, '')[i] = '1' THEN CAST(1 AS BIGINT) << CAST(56 - i AS BIGINT) ELSE 0 END))::BIGINT AS bits FROM e""")
def gradient_hashes(spark, sf_dir):
    h = hashes.gradient_hash(F.col("embedding"), 8)
    return fx.read(spark, sf_dir, "embeddings").select("vec_id", F.conv(h, 16, 10).cast("long").alias("bits"))


@query("hamming_distances", "SELECT p_partkey, CAST(bit_count(xor(p_partkey * 2654435761, p_partkey * 40503 + 7)) AS BIGINT) AS d FROM part")
def hamming_distances(spark, sf_dir):
    hex_ = lambda e: F.lower(F.lpad(F.hex(F.expr(e)), 16, "0"))
    return fx.read(spark, sf_dir, "part").select("p_partkey", hashes.hamming(hex_("p_partkey * 2654435761"), hex_("p_partkey * 40503 + 7")).alias("d"))


@query("validation_split", fx.OBS + "SELECT ord, CAST('0x' || substr(md5(filename || ':' || timestamp_ms), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.2::DOUBLE AS val FROM obs")
def validation_split(spark, sf_dir):
    return fx.obs(spark, sf_dir).select("ord", hashes.in_validation(F.col("filename"), F.col("timestamp_ms").cast("double"), 0.2).alias("val"))


@query("patch_pixels")
def patch_pixels(spark, sf_dir):
    """Sharpness and colour of 8 x 8 pictures made from embeddings, by numpy over Arrow batches."""

    def run(batches):
        for pdf in batches:
            x = [np.clip((np.resize(np.asarray(v, float), 192).reshape(8, 8, 3) + 1) * 127, 0, 255) for v in pdf.embedding]
            yield pd.DataFrame({"vec_id": pdf.vec_id, "sharpness": [round(images.sharpness(i), 6) for i in x], "color": [images.classify_color(i) for i in x], "regions": [len(images.color_boxes(i, 3)) for i in x]})

    return fx.read(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, sharpness double, color string, regions long")


# --- candidates, zones, regions

PANELS = fx.OBS + ", pc AS (SELECT ord, cents, x_min AS x, y_min AS y, x_max - x_min AS w, y_max - y_min AS h FROM obs), cb AS (" + " UNION ALL ".join(
    f"SELECT ord, cents, {k} AS k, {a} AS x_min, {b} AS y_min, {c} AS x_max, {d} AS y_max FROM pc"
    for k, (a, b, c, d) in enumerate(
        [v for m in candidates.PANEL_WIDTHS for v in ((f"x - w * 0.10::DOUBLE", "y - h * 0.06::DOUBLE", f"x + w * {m}::DOUBLE", "y + h * 1.06::DOUBLE"), (f"x - w * {m - 1.0!r}::DOUBLE", "y - h * 0.06::DOUBLE", "x + w * 1.10::DOUBLE", "y + h * 1.06::DOUBLE"))]
        + [v for m in candidates.STRIP_HEIGHTS for v in (("x - w * 0.06::DOUBLE", "y - h * 0.10::DOUBLE", "x + w * 1.06::DOUBLE", f"y + h * {m}::DOUBLE"), ("x - w * 0.06::DOUBLE", f"y - h * {m - 1.0!r}::DOUBLE", "x + w * 1.06::DOUBLE", "y + h * 1.10::DOUBLE"))]
    )
) + ")"


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.with_box(fx.obs(spark, sf_dir))
    return o.select("ord", "cents", F.explode(candidates.panel_candidates(F.col("box"))).alias("c")).select("ord", "cents", "c.k", "c.box")


@query("panel_candidates", PANELS + "SELECT ord, k, round(x_min, 6) AS x_min, round(y_min, 6) AS y_min, round(x_max, 6) AS x_max, round(y_max, 6) AS y_max FROM cb")
def panel_candidates(spark, sf_dir):
    return panels(spark, sf_dir).select("ord", "k", *(F.round(f"box.{c}", 6).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")))


@query("candidate_scores", PANELS + """, cl AS (SELECT ord, k, cents, greatest(0, least(3839, x_min)) AS x1, greatest(0, least(2159, y_min)) AS y1, greatest(0, least(3839, x_max)) AS x2, greatest(0, least(2159, y_max)) AS y2 FROM cb),
m AS (SELECT ord, k, least(x1, x2) AS x1, greatest(x1, x2) - least(x1, x2) AS w, greatest(y1, y2) - least(y1, y2) AS h, (cents % 40) / 100.0::DOUBLE AS red, (cents % 60) / 100.0::DOUBLE AS white, (cents % 11) / 100.0::DOUBLE AS edge FROM cl)
SELECT ord, k, round(0.45 + 0.18 * least(1.0, red / 0.30) + 0.18 * least(1.0, white / 0.45) + 0.14 * least(1.0, edge / 0.08) + 0.12 * greatest(0.0, 1.0 - abs(w / greatest(1.0, h) - 0.82) / 0.82)
 + 0.08 * greatest(0.0, 1.0 - abs(w * h / 8294400.0 - 0.0075) / 0.016), 6) AS score FROM m
WHERE w >= 24 AND h >= 24 AND w / greatest(1.0, h) BETWEEN 0.24 AND 1.85 AND w <= greatest(3840 * 0.18, 260) AND h <= greatest(2160 * 0.32, 260) AND w * h / 8294400.0 >= 0.0008 AND w * h <= greatest(8294400 * 0.05, 60000)
 AND red >= 0.045 AND white >= 0.16 AND edge >= 0.012""")
def candidate_scores(spark, sf_dir):
    w, h = F.lit(3840.0), F.lit(2160.0)
    red, white, edge = ((F.col("cents") % n).cast("double") / 100.0 for n in (40, 60, 11))
    c = panels(spark, sf_dir).withColumn("box", geometry.clip(F.col("box"), w, h))
    return c.where(candidates.red_white_ok(F.col("box"), w, h, red, white, edge)).select("ord", "k", F.round(candidates.red_white_score(F.col("box"), w, h, red, white, edge), 6).alias("score"))


#: Pictures that a task paints before it sends them on.
PICTURES = 32


def painted(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """A picture of each embedding: grey, with two white tags that have a red panel and dark lines, placed and sized by its values. With a size, its tiles."""
    height, width = 192, 256
    # few bytes, much work
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in (b.iloc[i : i + PICTURES] for b in batches for i in range(0, len(b), PICTURES)):
            out = []
            for v in batch.embedding:
                v = np.abs(np.nan_to_num(np.asarray(v, float)))
                x = np.full((height, width, 3), (90, 95, 100), np.uint8)
                for k in (0, 8):
                    a, b, c, d = (int(q * 997) for q in np.resize(v, 16)[k : k + 4])
                    y, z, h, w = a % 120, b % 170, 36 + c % 30, 44 + d % 36
                    x[y : y + h, z : z + w] = 235
                    x[y : y + h, z : z + w // 3] = (30, 30, 190 + a % 60)
                    x[y + 6 : y + h - 4 : 5, z + w // 2 : z + w - 4] = 25
                out.append(x if size else x.tobytes())
            if size:
                yield pd.DataFrame([t for k, x in zip(batch.vec_id.tolist(), out, strict=True) for t in masks.cut(k, x, size)], columns=masks.TILE_COLUMNS)
                continue
            yield pd.DataFrame({"picture": batch.vec_id, "height": height, "width": width, "pixels": out}).astype({"height": "int32", "width": "int32"})

    return fx.read(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding").repartition(n, "vec_id").mapInPandas(run, masks.TILE if size else "picture long, height int, width int, pixels binary")


@query("pixel_candidates")
def pixel_candidates(spark, sf_dir):
    """Candidates of tags from the pixels of pictures in tiles: masks, regions across tiles, shares of colours, scores."""
    c = masks.tag_candidates(painted(spark, sf_dir, 128), 128)
    return c.select("picture", *(F.round(f"box.{s}", 6).alias(s) for s in ("x_min", "y_min", "x_max", "y_max")), F.round("score", 6).alias("score"))


@query("contrast_variants")
def contrast_variants(spark, sf_dir):
    """Mean and spread of every variant that a code reader is given of each picture."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x = np.rint(images.gray(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3))).astype(np.uint8)
                out += [(r.picture, name, *v.shape, round(float(v.mean()), 6), round(float(v.std()), 6)) for name, v in contrast.variants(x).items()]
            yield pd.DataFrame(out, columns=["picture", "variant", "height", "width", "mean", "spread"])

    return painted(spark, sf_dir).mapInPandas(run, "picture long, variant string, height int, width int, mean double, spread double")


@query("colour_candidates", fx.OBS + """, p AS (SELECT ord, cents, x_min, y_min, x_max, y_max, x_max - x_min AS w, y_max - y_min AS h, (x_max - x_min) * (y_max - y_min) * (cents % 10) / 10.0::DOUBLE AS area, (cents % 9) / 100.0::DOUBLE AS edge FROM obs),
q AS (SELECT *, floor(greatest(14.0, least(110.0, w * 0.70::DOUBLE))) AS px, floor(greatest(12.0, least(115.0, h * 0.85::DOUBLE))) AS py FROM p WHERE area BETWEEN 900 AND 30000 AND w >= 8 AND h >= 8 AND w / greatest(1.0, h) BETWEEN 0.18 AND 6.0 AND area / greatest(1.0, w * h) >= 0.10),
r AS (SELECT *, greatest(0, least(3839, x_min - px)) AS x1, greatest(0, least(2159, y_min - py)) AS y1, greatest(0, least(3839, x_max + px)) AS x2, greatest(0, least(2159, y_max + py)) AS y2 FROM q)
SELECT ord, x1, y1, x2, y2, round(0.35 + least(0.45, area / (w * h) * 0.45) + least(0.20, edge), 6) AS score FROM r
WHERE NOT (cents % 2 = 0 AND edge < 0.02) AND (x2 - x1) * (y2 - y1) <= 8294400 * 0.020 AND x2 - x1 <= 3840 * 0.34 AND y2 - y1 <= 2160 * 0.45""")
def colour_candidates(spark, sf_dir):
    o, w, h = fx.with_box(fx.obs(spark, sf_dir)), F.lit(3840.0), F.lit(2160.0)
    b, edge = F.col("box"), (F.col("cents") % 9).cast("double") / 100.0
    o = o.withColumn("area", geometry.width(b) * geometry.height(b) * (F.col("cents") % 10) / 10.0).where(candidates.colour_ok(b, F.col("area"), 900, F.lit(30000.0)))
    o = o.withColumn("fill", F.col("area") / (geometry.width(b) * geometry.height(b))).withColumn("box", candidates.colour_box(b, w, h))
    o = o.where(candidates.colour_whole_ok(b, w, h, edge, F.col("cents") % 2 == 0))
    return o.select("ord", F.col("box.x_min").alias("x1"), F.col("box.y_min").alias("y1"), F.col("box.x_max").alias("x2"), F.col("box.y_max").alias("y2"), F.round(candidates.colour_score(F.col("fill"), edge), 6).alias("score"))


ZONE_ROWS = ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {d})" for i, (n, (a, b, c, d)) in enumerate(candidates.ZONES.items()))


@query("ocr_zones", fx.OBS + f""", pic AS (SELECT ord, CAST(x_max - x_min AS INTEGER) - 90 + cents % 60 AS w, CAST(y_max - y_min AS INTEGER) - 60 AS h FROM obs), zn(i, zone, a, b, c, d) AS (VALUES {ZONE_ROWS}),
z AS (SELECT ord, w, h, i, zone, greatest(0, least(w - 1, round_even(a::DOUBLE * w, 0)))::INT AS x1, greatest(0, least(h - 1, round_even(b::DOUBLE * h, 0)))::INT AS y1, greatest(0, least(w, round_even(c::DOUBLE * w, 0)))::INT AS x2, greatest(0, least(h, round_even(d::DOUBLE * h, 0)))::INT AS y2 FROM pic, zn WHERE w > 0 AND h > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY ord, x2 - x1, y2 - y1 ORDER BY i) AS r FROM z WHERE CASE WHEN w < 24 OR h < 24 THEN zone = 'full' ELSE x2 - x1 >= 18 AND y2 - y1 >= 18 END)
SELECT ord, i, zone, x1, y1, x2, y2 FROM f WHERE r = 1 OR zone = 'full'""")
def ocr_zones(spark, sf_dir):
    p = fx.obs(spark, sf_dir).selectExpr("ord", "cast(cast(x_max - x_min AS int) - 90 + cents % 60 AS int) AS w", "cast(y_max - y_min AS int) - 60 AS h")
    return candidates.zones(p, "ord", "w", "h")


PRIOR_ROWS = ", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in x)})" for k, x in enumerate(candidates.PRIORS))
PRIORS = fx.OBS + f", pr(k, a, b, c, d) AS (VALUES {PRIOR_ROWS}), p AS (SELECT ord, k, floor(a * (x_max - x_min))::INT AS x1, floor(b * (y_max - y_min))::INT AS y1, floor(c * (x_max - x_min))::INT AS x2, floor(d * (y_max - y_min))::INT AS y2 FROM obs, pr)"


@query("code_priors", PRIORS + "SELECT * FROM p")
def code_priors(spark, sf_dir):
    return fx.obs(spark, sf_dir).select("ord", F.explode(candidates.priors(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))).alias("p")).select("ord", "p.*")


@query("code_regions", fx.OBS + """, g AS (SELECT filename, frame_index, ord, CASE WHEN cents % 5 = 0 THEN ord END AS prior, score FROM obs), n AS (SELECT *, count(prior) OVER (PARTITION BY filename, frame_index) AS n, row_number() OVER (PARTITION BY filename, frame_index ORDER BY prior IS NULL, prior, score DESC, ord) AS r FROM g)
SELECT filename || ':' || frame_index AS frame, ord, CAST(r AS INTEGER) AS place FROM n WHERE r <= 12 AND r <= n + greatest(0, 12 - n) + 4""")
def code_regions(spark, sf_dir):
    g = fx.obs(spark, sf_dir).select(F.concat_ws(":", "filename", "frame_index").alias("frame"), "ord", F.when(F.col("cents") % 5 == 0, F.col("ord")).alias("prior"), "score")
    return candidates.chosen_regions(g, "frame")


@query("recovered_sources", fx.OBS + """SELECT k.filename, k.frame_index, k.ord, arg_max(f.source, (f.score, -f.ord)) AS source FROM obs k JOIN obs f ON k.filename = f.filename AND k.frame_index = f.frame_index
 AND abs(k.x_min - f.x_min) + abs(k.y_min - f.y_min) + abs(k.x_max - f.x_max) + abs(k.y_max - f.y_max) < 4 GROUP BY ALL""")
def recovered_sources(spark, sf_dir):
    o = fx.with_box(fx.obs(spark, sf_dir))
    return candidates.recovered_sources(o.select("filename", "frame_index", "ord", "box"), o, ["filename", "frame_index"])


# --- rows of groups, the whole way

QUALITY = """35.0 * CAST(barcode <> '' AS INTEGER) + 25.0 * CAST(has_qr AS INTEGER) + least(15.0, length(trim(text)) * 0.03::DOUBLE) + 1.0 + (x_max - x_min) * (y_max - y_min) * 0.0001::DOUBLE
 + 8.0 * (6 + CAST(product_name NOT IN ('', 'нет', 'νες') AS INTEGER) + CAST(price_default <> '' AS INTEGER) + CAST(barcode <> '' AS INTEGER))"""
GROUPED = fx.TRACK_ROWS + f""", q AS (SELECT *, 'g' || (track_id % 50) AS grp, {QUALITY} AS quality_ FROM tr),
best AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY filename, grp ORDER BY round(quality_, 6) DESC, ord) = 1),
v AS (SELECT filename, grp, 'product_name' AS c, CASE WHEN product_name = 'νες' THEN 'нет' ELSE product_name END AS v, ord FROM tr2 UNION ALL SELECT filename, grp, 'price_default', price_default, ord FROM tr2 UNION ALL SELECT filename, grp, 'barcode', barcode, ord FROM tr2),
n AS (SELECT filename, grp, c, v, count(*) AS n, min(ord) AS o FROM v WHERE v <> '' GROUP BY ALL), m AS (SELECT filename, grp, c, arg_max(v, (n, v <> 'нет', length(v), -o)) AS v FROM n GROUP BY ALL),
f AS (SELECT b.filename, b.grp, b.timestamp_ms AS frame_timestamp, b.x_min, b.y_min, coalesce(max(m.v) FILTER (WHERE c = 'product_name'), '') AS product_name, coalesce(max(m.v) FILTER (WHERE c = 'price_default'), '') AS price_default, coalesce(max(m.v) FILTER (WHERE c = 'barcode'), '') AS barcode
 FROM best b LEFT JOIN m ON b.filename = m.filename AND b.grp = m.grp GROUP BY ALL)""".replace("tr2", "(SELECT *, 'g' || (track_id % 50) AS grp FROM tr)")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.track_rows(spark, sf_dir).withColumns({"group_key": F.concat(F.lit("g"), F.col("track_id") % 50), "has_qr": F.size("payloads") > 0, "observations": F.lit(1), "best_text": F.col("text")})
    r = r.withColumns({c: F.lit("") for c in tables.TAG_COLUMNS if c not in r.columns})
    return runs.fuse_groups(r.withColumn("product_name", t.canonical(F.col("product_name"))), ["filename", "group_key"])


@query("group_fusion", GROUPED + "SELECT filename, grp AS group_key, frame_timestamp, x_min, y_min, product_name, price_default, barcode FROM f")
def group_fusion(spark, sf_dir):
    return grouped(spark, sf_dir).select("filename", "group_key", "frame_timestamp", "x_min", "y_min", "product_name", "price_default", "barcode")


@query("sorted_rows", GROUPED + "SELECT row_number() OVER (ORDER BY filename, frame_timestamp, y_min, x_min, grp) AS place, filename, frame_timestamp, product_name FROM f ORDER BY place LIMIT 200")
def sorted_rows(spark, sf_dir):
    """The first rows of the table, as a preview shows them."""
    top = runs.in_order(grouped(spark, sf_dir)).orderBy("filename", "frame_timestamp", "y_min", "x_min", "group_key").limit(200)
    return top.select(F.row_number().over(Window.orderBy("filename", "frame_timestamp", "y_min", "x_min", "group_key")).cast("long").alias("place"), "filename", "frame_timestamp", "product_name")


@query("track_records", REP + """, r AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(s, 9) DESC, ord) = 1), g AS (SELECT track_id, count(*) AS observations, min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts FROM tr GROUP BY track_id),
v AS (SELECT track_id, 'product_name' AS c, CASE WHEN product_name = 'νες' THEN 'нет' ELSE product_name END AS v, ord FROM tr UNION ALL SELECT track_id, 'price_default', price_default, ord FROM tr UNION ALL SELECT track_id, 'barcode', barcode, ord FROM tr),
n AS (SELECT track_id, c, v, count(*) AS n, min(ord) AS o FROM v WHERE v <> '' GROUP BY ALL), b AS (SELECT track_id, c, arg_max(v, (n, v <> 'нет', length(v), -o)) AS v FROM n GROUP BY ALL)
SELECT r.track_id, r.ord, g.observations, g.first_ts, g.last_ts, r.filename, r.timestamp_ms AS frame_timestamp, coalesce(max(b.v) FILTER (WHERE c = 'product_name'), '') AS product_name, coalesce(max(b.v) FILTER (WHERE c = 'price_default'), '') AS price_default,
 coalesce(max(b.v) FILTER (WHERE c = 'barcode'), '') AS barcode, '' AS id_sku FROM r JOIN g USING (track_id) LEFT JOIN b USING (track_id) GROUP BY ALL""")
def track_records(spark, sf_dir):
    o = fx.track_rows(spark, sf_dir).withColumn("visual_hash", F.lit(""))
    return runs.fuse_tracks(o, ["track_id"], 1, 8.0).select("track_id", "ord", "observations", "first_ts", "last_ts", "filename", "frame_timestamp", "product_name", "price_default", "barcode", "id_sku")


@query("run_video")
def run_video(spark, sf_dir):
    o = fx.track_rows(spark, sf_dir).drop("track_id").withColumn("visual_hash", F.lower(F.lpad(F.hex(F.col("cents") * 2654435761), 16, "0")))
    return runs.run(frames(spark, sf_dir), o, weight=8.0)


# --- evaluation and data sets


@query("frame_stats", fx.OBS + "SELECT filename, frame_index, count(*) AS detections, count(*) FILTER (WHERE score >= 0.18) AS observations, CAST(sum(count(*)) OVER (PARTITION BY filename) AS BIGINT) AS total FROM obs GROUP BY filename, frame_index")
def frame_stats(spark, sf_dir):
    return profile.frame_stats(fx.obs(spark, sf_dir), F.col("score") >= 0.18)


@query("unmatched_predictions")
def unmatched_predictions(spark, sf_dir):
    pred = fx.with_box(fx.predicted(spark, sf_dir))
    met = boxes.greedy_match(fx.with_box(fx.truth(spark, sf_dir)), pred, "frame")
    return pred.select("ord").join(met.select(F.col("pred_ord").alias("ord")), "ord", "left_anti")


@query("files_by_stem", FILES + ", p AS (SELECT DISTINCT path, regexp_replace(split_part(path, '/', 2), '\\.[a-z0-9]+$', '') AS stem, path LIKE '%.mp4' AS v FROM f) SELECT a.path AS truth, b.path AS prediction FROM p a LEFT JOIN p b ON a.stem = b.stem AND b.v WHERE NOT a.v")
def files_by_stem(spark, sf_dir):
    p = files(spark, sf_dir)
    return tables.by_stem(p.where("path LIKE '%.csv'"), p.where("path LIKE '%.mp4'")).select(F.col("path").alias("truth"), F.col("other").alias("prediction"))


@query("run_artifacts", RUNS + """, s AS (SELECT run, 'exp ' || run AS experiment FROM run WHERE run <> 'run3' GROUP BY run), y AS (SELECT run, round(sum(matched) / sum(gt), 6) AS recall FROM run WHERE run <> 'run1' GROUP BY run), m AS (SELECT run, CAST(sum(good) AS BIGINT) AS good80 FROM run WHERE run <> 'run0' GROUP BY run)
SELECT r.run, coalesce(experiment, '') AS experiment, y.recall AS yolo_recall, coalesce(good80, 0) AS good80 FROM (SELECT DISTINCT run FROM run) r LEFT JOIN s ON r.run = s.run LEFT JOIN y ON r.run = y.run LEFT JOIN m ON r.run = m.run""")
def run_artifacts(spark, sf_dir):
    m = run_metrics(spark, sf_dir)
    summary = m.where("run <> 'run3'").select("run", F.concat(F.lit("exp "), "run").alias("experiment")).distinct()
    yolo = m.where("run <> 'run1'").groupBy("run").agg(F.round(F.sum("matched") / F.sum("gt"), 6).alias("yolo_recall"))
    good = m.where("run <> 'run0'").groupBy("run").agg(F.sum("good").alias("good80"))
    return profile.joined_artifacts(m.select("run").distinct(), "run", [summary, yolo, good]).na.fill({"experiment": "", "good80": 0})


@query("label_frames", FRAMES + "SELECT o.filename, o.timestamp_ms, count(*) AS labels, any_value(f.frame_index) AS frame_index FROM obs o JOIN fr f ON o.filename = f.filename AND o.timestamp_ms = f.timestamp_ms WHERE f.sharpness >= 10 GROUP BY o.filename, o.timestamp_ms")
def label_frames(spark, sf_dir):
    labels = fx.obs(spark, sf_dir).groupBy("filename", "timestamp_ms").agg(F.count("*").alias("labels"))
    return labels.join(frames(spark, sf_dir).where("sharpness >= 10").select("filename", "timestamp_ms", "frame_index"), ["filename", "timestamp_ms"])


@query("run_diagnostics", fx.TRACK_ROWS + "SELECT 'run' || (cents % 4) AS run, filename AS video, count(*) AS pred, count(*) FILTER (WHERE product_name IN ('', 'нет') AND barcode = '') AS no_evidence, count(*) FILTER (WHERE product_name NOT IN ('', 'нет')) AS product_name, count(*) FILTER (WHERE barcode <> '') AS barcode FROM tr GROUP BY ALL")
def run_diagnostics(spark, sf_dir):
    r = fx.track_rows(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), F.col("cents") % 4))
    return profile.diagnostics(r, ["run", "filename"], ["product_name", "barcode"]).withColumnRenamed("filename", "video")


@query("pseudo_scan", FRAMES + ", hit AS (SELECT filename, frame_index, count(*) AS n FROM obs WHERE score >= 0.6 AND frame_index % 2 = 0 GROUP BY ALL) SELECT filename, frame_index, n FROM hit QUALIFY row_number() OVER (PARTITION BY filename ORDER BY frame_index) <= 8")
def pseudo_scan(spark, sf_dir):
    return tables.scan_with_hits(frames(spark, sf_dir), fx.obs(spark, sf_dir).where("score >= 0.6"), F.lit(5.0), 2.5, 8)


@query("dataset_union", fx.OBS + "SELECT filename AS video, 'base' AS part, count(*) AS n FROM obs WHERE score >= 0.9 GROUP BY ALL UNION ALL SELECT filename, 'pseudo', count(*) FROM obs WHERE score < 0.9 AND score >= 0.6 GROUP BY ALL")
def dataset_union(spark, sf_dir):
    o = fx.obs(spark, sf_dir)
    return tables.union_of({"base": o.where("score >= 0.9"), "pseudo": o.where("score < 0.9 AND score >= 0.6")}, "part").groupBy(F.col("filename").alias("video"), "part").agg(F.count("*").alias("n"))


@query("propagation_chain", fx.TRACK_ROWS + """, c AS (SELECT track_id, ord, timestamp_ms, score, row_number() OVER (PARTITION BY track_id ORDER BY timestamp_ms, ord) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM tr), s AS (SELECT *, i - (n + 1) // 2 AS step FROM c),
a AS (SELECT *, min(CASE WHEN score >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, step > 0 ORDER BY abs(step)) AS ok FROM s WHERE step <> 0 AND abs(step) <= 6) SELECT track_id, ord, step FROM a WHERE ok = 1""")
def propagation_chain(spark, sf_dir):
    r = fx.track_rows(spark, sf_dir)
    return tracking.propagated(r, ["track_id"], ["timestamp_ms", "ord"], F.col("score") >= 0.1, 6).select("track_id", "ord", "step")
