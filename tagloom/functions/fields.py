"""Fields of one tag from its text lines and payloads, as one map expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT, FIELD_COLUMNS, PAYLOAD_KEYS, PRICE_COLUMNS
from . import text as t
from .payloads import parse_payloads


def text_fields(full: Column, named: Column, priced: Column, payload_fields: Column) -> dict[str, Column]:
    """Each field as a column, null where nothing is known.

    full: the normalised text; named: lines that may name a product; priced: see price_roles(). Payloads come first, then
    what the text says; some fields the text overrides, some are "absent" where nothing is found.
    """
    f: dict[str, Column] = {k: F.element_at(payload_fields, k) for k in PAYLOAD_KEYS}
    some = lambda x: F.when(x != "", x)
    p = priced
    f["price_default"] = F.coalesce(some(f["price1_qr"]), p["default"])
    f["price_card"] = F.coalesce(some(f["price4_qr"]), p["card"])
    f["price_discount"] = F.coalesce(some(f["action_price_qr"]), p["discount"], F.lit(ABSENT))
    f["discount_amount"] = F.coalesce(F.concat(F.lit("-"), t.first_group(full, t.DISCOUNT), F.lit("%")), F.lit(ABSENT))
    f["print_datetime"] = F.replace(t.first_group(full, t.PRINTED), F.lit("-"), F.lit("."))
    f["code"] = F.coalesce(F.replace(t.first_group(full, t.ZONE), F.lit(" ")), F.lit(ABSENT))
    f["barcode"] = F.coalesce(F.when(some(f["qr_code_barcode"]).isNotNull(), F.regexp_replace(f["qr_code_barcode"], "[^0-9]", "")), F.get(t.barcodes(full), 0))
    runs = F.regexp_extract_all(full, F.lit(t.SKU_RUN), F.lit(1))
    runs = F.filter(runs, lambda s: ~s.eqNullSafe(f["barcode"]))
    f["id_sku"] = F.coalesce(F.get(F.filter(runs, lambda s: (F.length(s) >= 10) & s.rlike("^[23]")), 0), F.get(runs, 0))
    f["special_symbols"] = F.coalesce(F.upper(t.first_group(F.replace(full, F.lit("|"), F.lit(" ")), t.SPECIAL)), F.lit(ABSENT))
    f["product_name"] = F.when(F.size(named) > 0, t.clean_product_name(F.array_join(F.slice(named, 1, 3), " ")))
    f["additional_info"] = F.coalesce(t.info_words(full), F.lit(ABSENT))
    for c in PRICE_COLUMNS:
        f[c] = F.when(f[c].isin("", ABSENT), f[c]).otherwise(F.when(f[c].isNotNull(), t.price_to_str(f[c])))
    return {k: F.when(v.isNotNull(), t.canonical(v)) for k, v in f.items()}


def price_roles(prices: Column) -> Column:
    """default, card and discount price among all prices found."""
    numbers = F.transform(prices, lambda p: p.cast("double"))
    n, most, least = F.size(prices), t.two_decimals(F.array_max(numbers)), t.two_decimals(F.array_min(numbers))
    default = F.when(n >= 2, most).when(n == 1, F.get(prices, 0))
    return F.struct(default.alias("default"), F.when(n >= 2, least).alias("card"), F.when(n >= 3, least).alias("discount"))


def parse_observation(lines: Column, payloads: Column) -> Column:
    """A struct of all field columns of a tag row, blank where nothing is known. lines: array<string>, most confident first."""

    def parts(b: Column) -> Column:
        priced = t.let(t.find_prices_in_lines(b["lines"], b["full"]), price_roles)
        return t.let(F.struct(b["full"].alias("full"), t.product_lines(b["lines"]).alias("named"), priced.alias("priced"), b["m"].alias("m")), row)

    def row(b: Column) -> Column:
        found = text_fields(b["full"], b["named"], b["priced"], b["m"])
        return F.struct(*(F.coalesce(found.get(c, F.lit("")), F.lit("")).alias(c) for c in FIELD_COLUMNS))

    return t.let(F.struct(lines.alias("lines"), t.normalize_text(F.array_join(lines, "\n")).alias("full"), parse_payloads(payloads).alias("m")), parts)
