"""Relations derived from the driver's tables by integer arithmetic, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the events table."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id", "cast(round(value * 100) as bigint) AS cents", "unix_millis(cast(ts AS timestamp)) - 1704067200000 AS ms", "user_id div 12 AS slot")
    return e.selectExpr(
        "event_id AS ord", "concat('v', user_id % 12, '.mp4') AS filename", "ms div 43200000 AS frame_index", "(ms div 43200000) * 500 AS timestamp_ms",
        "cast(slot * 90 + cents % 40 AS double) AS x_min", "cast(100 + cents % 23 AS double) AS y_min", "cast(slot * 90 + cents % 40 + 100 + cents % 30 AS double) AS x_max", "cast(180 + cents % 23 + cents % 17 AS double) AS y_max",
        "cast(cents % 1000 AS double) / 1000 AS score", "CASE event_type WHEN 'purchase' THEN 'yolo' WHEN 'click' THEN 'heuristic' WHEN 'view' THEN 'red_white_tag' WHEN 'error' THEN 'qr_seed' ELSE 'color' END AS source", "cents",
    )


OBS = """
WITH e0 AS (SELECT event_id, event_type, user_id, CAST(round(value * 100) AS BIGINT) AS cents, epoch_ms(ts) - 1704067200000 AS ms, user_id // 12 AS slot FROM events),
obs AS (SELECT event_id AS ord, 'v' || (user_id % 12) || '.mp4' AS filename, ms // 43200000 AS frame_index, (ms // 43200000) * 500 AS timestamp_ms,
  CAST(slot * 90 + cents % 40 AS DOUBLE) AS x_min, CAST(100 + cents % 23 AS DOUBLE) AS y_min, CAST(slot * 90 + cents % 40 + 100 + cents % 30 AS DOUBLE) AS x_max,
  CAST(180 + cents % 23 + cents % 17 AS DOUBLE) AS y_max, CAST(cents % 1000 AS DOUBLE) / 1000 AS score,
  CASE event_type WHEN 'purchase' THEN 'yolo' WHEN 'click' THEN 'heuristic' WHEN 'view' THEN 'red_white_tag' WHEN 'error' THEN 'qr_seed' ELSE 'color' END AS source, cents FROM e0)
"""


def with_box(df: DataFrame) -> DataFrame:
    sides = ("x_min", "y_min", "x_max", "y_max")
    return df.withColumn("box", F.struct(*sides)).drop(*sides)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of few bytes and much work, in as many tasks as a shuffle has: a file is read by one task or two, and small shuffles are put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def tag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord and lines of made-up tags, from part: prices in three spellings, discount, print time, zone, codes."""
    p = dealt(read(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey AS k", "p_name", "cast(round(p_retailprice * 100) AS bigint) AS c")
    return p.selectExpr(
        "k AS ord",
        """array(concat('Молоко ', p_name, CASE WHEN k % 5 = 0 THEN '  сухое' ELSE '' END),
             CASE k % 3 WHEN 0 THEN concat(c div 100, ',', lpad(c % 100, 2, '0'), ' руб') WHEN 1 THEN concat(c div 100, ' ', lpad(c % 100, 2, '0')) ELSE concat(c div 100, lpad(c % 100, 2, '0')) END,
             CASE WHEN k % 4 = 0 THEN concat(c div 200 + 2, '.', lpad(k % 100, 2, '0')) ELSE concat('-', k % 90, '%') END,
             concat(lpad(k % 28 + 1, 2, '0'), '-', lpad(k % 12 + 1, 2, '0'), '-2026 ', k % 24, ':', lpad(k % 60, 2, '0')),
             CASE WHEN k % 2 = 0 THEN concat(lpad(k % 100, 2, '0'), '_', lpad(k, 6, '0'), ' - ', lpad(c, 6, '0')) ELSE ' Ш ' END,
             CASE WHEN k % 7 = 0 THEN '4670025474665' ELSE concat('2', lpad(k, 11, '0')) END) AS lines""",
    )


TAG_TEXT = """
WITH p AS (SELECT p_partkey AS k, p_name, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
tag AS (SELECT k AS ord, [
  'Молоко ' || p_name || CASE WHEN k % 5 = 0 THEN '  сухое' ELSE '' END,
  CASE k % 3 WHEN 0 THEN (c // 100) || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' руб' WHEN 1 THEN (c // 100) || ' ' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') ELSE (c // 100) || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END,
  CASE WHEN k % 4 = 0 THEN (c // 200 + 2) || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') ELSE '-' || (k % 90) || '%' END,
  lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-2026 ' || (k % 24) || ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0'),
  CASE WHEN k % 2 = 0 THEN lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '_' || lpad(CAST(k AS VARCHAR), 6, '0') || ' - ' || lpad(CAST(c AS VARCHAR), 6, '0') ELSE ' Ш ' END,
  CASE WHEN k % 7 = 0 THEN '4670025474665' ELSE '2' || lpad(CAST(k AS VARCHAR), 11, '0') END] AS lines FROM p)
"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord and one payload, in six dialects."""
    o = obs(spark, sf_dir).selectExpr("ord", "cents AS c", "lpad(ord, 12, '4') AS code")
    return o.selectExpr(
        "ord",
        """CASE ord % 6 WHEN 0 THEN code WHEN 1 THEN concat('(01)0', lpad(ord, 13, '7'))
             WHEN 2 THEN concat('{"barcode":"', code, '","price1":"', c div 100, '.', lpad(c % 100, 2, '0'), '","actionCode":null}')
             WHEN 3 THEN concat('https://shop.example/t?b=', code, '&p1=', c div 100, '%2C', lpad(c % 100, 2, '0'), ';aC=A+', ord % 9, '&b=', code)
             WHEN 4 THEN concat('Barcode: ', code, ', p4: ', c div 100, '.5') ELSE concat('b', code, ' p2', c div 100, '.25') END AS payload""",
    )


PAYLOADS = OBS + """,
o AS (SELECT ord, cents AS c, lpad(CAST(ord AS VARCHAR), 12, '4') AS code FROM obs),
pay AS (SELECT ord, ord % 6 AS dialect, code, c,
  (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS price, lpad(CAST(ord AS VARCHAR), 13, '7') AS gtin FROM o)
"""


def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of made-up tracks: each detection with text fields that repeat, are blank or absent."""
    o = obs(spark, sf_dir)
    return o.selectExpr(
        "*", "ord % 400 AS track_id", "timestamp_ms AS frame_timestamp",
        "CASE cents % 5 WHEN 0 THEN '' WHEN 1 THEN 'нет' WHEN 2 THEN 'νες' ELSE concat('Сыр ', cents % 3) END AS product_name",
        "CASE cents % 4 WHEN 0 THEN '' ELSE concat(cents % 7 + 10, '.50') END AS price_default",
        "CASE WHEN ord % 400 % 3 = 0 THEN concat('46000000', lpad(ord % 400 % 20, 5, '0')) ELSE '' END AS barcode",
        "CASE WHEN cents % 11 = 0 THEN array(concat('b=', ord)) ELSE cast(array() AS array<string>) END AS payloads",
        "CASE WHEN cents % 3 = 0 THEN '' ELSE repeat('т', cast(cents % 50 AS int)) END AS text", "cast(cents % 90 AS double) AS quality",
    )


TRACK_ROWS = OBS + """,
tr AS (SELECT *, ord % 400 AS track_id, timestamp_ms AS frame_timestamp,
  CASE cents % 5 WHEN 0 THEN '' WHEN 1 THEN 'нет' WHEN 2 THEN 'νες' ELSE 'Сыр ' || (cents % 3) END AS product_name,
  CASE cents % 4 WHEN 0 THEN '' ELSE (cents % 7 + 10) || '.50' END AS price_default,
  CASE WHEN ord % 400 % 3 = 0 THEN '46000000' || lpad(CAST(ord % 400 % 20 AS VARCHAR), 5, '0') ELSE '' END AS barcode,
  cents % 11 = 0 AS has_qr, CASE WHEN cents % 3 = 0 THEN '' ELSE repeat('т', CAST(cents % 50 AS INTEGER)) END AS text, CAST(cents % 90 AS DOUBLE) AS quality FROM obs)
"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections, as labelled."""
    return obs(spark, sf_dir).selectExpr("*", "concat(filename, ':', frame_index) AS frame")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted, some dropped, some doubled."""
    o = obs(spark, sf_dir).where("ord % 10 <> 0")
    moved = o.selectExpr("ord * 2 AS ord", "filename", "frame_index", "timestamp_ms", "x_min + cents % 9 AS x_min", "y_min", "x_max + cents % 9 AS x_max", "y_max", "score", "source", "cents", "concat(filename, ':', frame_index) AS frame")
    return moved.unionByName(moved.where("ord % 14 = 0").withColumn("ord", F.col("ord") + 1))


TRUTH = OBS + """,
gt AS (SELECT *, filename || ':' || frame_index AS frame FROM obs),
mv AS (SELECT ord * 2 AS ord, filename, frame_index, timestamp_ms, x_min + cents % 9 AS x_min, y_min, x_max + cents % 9 AS x_max, y_max, score, source, cents,
       filename || ':' || frame_index AS frame FROM obs WHERE ord % 10 <> 0),
pred AS (SELECT * FROM mv UNION ALL SELECT * REPLACE (ord + 1 AS ord) FROM mv WHERE ord % 14 = 0)
"""

#: Overlap of boxes a and b in DuckDB.
MACROS = {
    "iou": """(CASE WHEN ({a}x_max-{a}x_min)*({a}y_max-{a}y_min) + ({b}x_max-{b}x_min)*({b}y_max-{b}y_min) - greatest(0, least({a}x_max,{b}x_max)-greatest({a}x_min,{b}x_min)) * greatest(0, least({a}y_max,{b}y_max)-greatest({a}y_min,{b}y_min)) > 0
 THEN greatest(0, least({a}x_max,{b}x_max)-greatest({a}x_min,{b}x_min)) * greatest(0, least({a}y_max,{b}y_max)-greatest({a}y_min,{b}y_min)) /
 (({a}x_max-{a}x_min)*({a}y_max-{a}y_min) + ({b}x_max-{b}x_min)*({b}y_max-{b}y_min) - greatest(0, least({a}x_max,{b}x_max)-greatest({a}x_min,{b}x_min)) * greatest(0, least({a}y_max,{b}y_max)-greatest({a}y_min,{b}y_min))) ELSE 0 END)""",
}


def iou_sql(a: str, b: str) -> str:
    return MACROS["iou"].format(a=a, b=b)
