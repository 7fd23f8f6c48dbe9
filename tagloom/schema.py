"""Column names, aliases and word lists of the tag data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The output row, in order.
TAG_COLUMNS = [
    "filename", "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku",
    "print_datetime", "code", "additional_info", "color", "special_symbols", "frame_timestamp", "x_min", "y_min", "x_max",
    "y_max", "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_count",
    "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price", "action_price_qr", "action_code_qr",
]
KEY_COLUMNS = ["filename", "frame_timestamp", "x_min", "y_min", "x_max", "y_max"]
FIELD_COLUMNS = [c for c in TAG_COLUMNS if c not in KEY_COLUMNS]
ABSENT = "нет"
LEGACY_NAMES = {"wholesale_level_1_coun": "wholesale_level_1_count"}
# Payload keys of each field, in order of preference.
PAYLOAD_KEYS = {
    "qr_code_barcode": ["barcode", "b"],
    "price1_qr": ["price1", "p1"],
    "price2_qr": ["price2", "p2"],
    "price3_qr": ["price3", "p3"],
    "price4_qr": ["price4", "p4"],
    "wholesale_level_1_count": ["wholesaleLevel1Count", "wL1C"],
    "wholesale_level_1_price": ["wholesaleLevel1Price", "wL1P"],
    "wholesale_level_2_count": ["wholesaleLevel2Count", "wL2C"],
    "wholesale_level_2_price": ["wholesaleLevel2Price", "wL2P"],
    "action_price_qr": ["actionPrice", "aP"],
    "action_code_qr": ["actionCode", "aC"],
}
COMPACT_KEYS = ["barcode", "b", "p1", "p2", "p3", "p4", "aP", "aC", "wL1C", "wL1P", "wL2C", "wL2P"]
STABLE_IDS = ["qr_code_barcode", "barcode", "id_sku", "code"]
PRICE_COLUMNS = ["price_default", "price_card", "price_discount", "price1_qr", "price2_qr", "price3_qr", "price4_qr", "action_price_qr", "wholesale_level_1_price", "wholesale_level_2_price"]
SEMANTIC_COLUMNS = ["qr_code_barcode", "barcode", "id_sku", "price_default", "price_card", "price_discount", "product_name", "print_datetime"]
MACHINE_COLUMNS = [*STABLE_IDS, "price1_qr", "price2_qr", "price3_qr", "price4_qr", "action_price_qr", "action_code_qr"]
FALLBACK_SOURCES = ["heuristic", "red_white_tag", "qr_seed", "color_geometry"]
# Words looked for on a tag, and fields that the similarity of rows compares.
INFO_WORDS = ["сухое", "полусухое", "полусладкое", "сладкое", "брют", "экстра", "удачная упаковка", "номер на весах", "цена за 1 кг", "цена за 100 г", "100г", "1кг", "1 кг"]
COMPARED_COLUMNS = [
    "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "print_datetime", "code", "additional_info",
    "color", "special_symbols", "qr_code_barcode", "price1_qr", "price2_qr", "price3_qr", "price4_qr", "action_price_qr", "action_code_qr",
]

BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x_min", "y_min", "x_max", "y_max")])
TAG_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c == "frame_timestamp" else T.DoubleType() if c in KEY_COLUMNS[2:] else T.StringType()) for c in TAG_COLUMNS])
