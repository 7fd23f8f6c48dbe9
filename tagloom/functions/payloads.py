"""Machine-code payloads: several dialects to one set of fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT, COMPACT_KEYS, PAYLOAD_KEYS
from .text import let, price_to_str

MAP = "map<string,string>"
PAIR = r"([A-Za-z0-9_]+)\s*[:=]\s*([^;&|,\n\r]+)"


def last_wins(pairs: Column) -> Column:
    """A map of array<struct(k, v)>; of repeated keys the last counts."""
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(let(pairs, last))


def query_map(query: Column) -> Column:
    """Decoded parameters of a query string; blank values stay."""
    parts = F.filter(F.split(F.regexp_replace(query, "[;|]", "&"), "&"), lambda p: p != "")

    def pair(p: Column) -> Column:
        decode = lambda x: F.coalesce(F.try_url_decode(x), x)
        eq = F.instr(p, "=")
        return F.struct(decode(F.when(eq > 0, F.substring(p, F.lit(1), eq - 1)).otherwise(p)).alias("k"), decode(F.when(eq > 0, F.substring(p, eq + 1, F.length(p))).otherwise(F.lit(""))).alias("v"))

    return last_wins(F.transform(parts, pair))


def pair_map(raw: Column) -> Column:
    """key: value or key=value pairs anywhere in a text."""
    keys, values = F.regexp_extract_all(raw, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(raw, F.lit(PAIR), F.lit(2))
    return last_wins(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.trim(v).alias("v"))))


def compact_map(raw: Column) -> Column:
    """Known keys with the value right behind them."""
    found = [F.struct(F.lit(k).alias("k"), F.regexp_extract(raw, rf"(?U)(?:^|\W){k}\W*([0-9A-Za-z.,_-]+)", 1).alias("v")) for k in COMPACT_KEYS]
    return F.map_from_entries(F.filter(F.array(*found), lambda p: p["v"] != ""))


def payload_map(payload: Column) -> Column:
    """Raw keys and values: the first dialect that gives any."""
    raw = F.trim(payload)
    as_json = F.when(raw.rlike(r"(?s)^\{.*\}$"), F.map_filter(F.from_json(raw, MAP), lambda _, v: v.isNotNull()))
    url_query = F.try_parse_url(raw, F.lit("QUERY"))
    query = F.when(url_query.isNotNull() & (url_query != ""), url_query).when(F.contains(raw, F.lit("=")), raw)
    some = lambda m: let(m, lambda x: F.when(F.size(x) > 0, x))
    return F.coalesce(some(as_json), some(query_map(query)), some(pair_map(raw)), compact_map(raw))


def parse_payload(payload: Column) -> Column:
    """map of fields of one payload: bare codes first, then the dialects' keys by their aliases."""
    raw = F.trim(F.coalesce(payload, F.lit("")))
    gtin = F.regexp_extract(raw, r"\(01\)\s*([0-9]{14})", 1)
    code = F.when(raw.rlike("^[0-9]{8,14}$"), raw).when(gtin != "", F.regexp_replace(gtin, "^0", ""))

    def known(data: Column) -> Column:
        lower = last_wins(F.transform(F.map_entries(data), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
        return let(F.struct(data.alias("data"), lower.alias("lower")), aliased)

    def aliased(m: Column) -> Column:
        found = []
        for field, keys in PAYLOAD_KEYS.items():
            options = [F.nullif(F.trim(F.coalesce(F.element_at(m["data"], k), F.element_at(m["lower"], k.lower()))), F.lit("")) for k in keys]
            found.append(F.struct(F.lit(field).alias("k"), F.coalesce(*options).alias("v"), F.lit("price" in field).alias("price")))
        values = F.filter(F.array(*found), lambda f: f["v"].isNotNull())
        return F.map_from_entries(F.transform(values, lambda f: F.struct(f["k"].alias("k"), F.when(f["price"], price_to_str(f["v"])).otherwise(f["v"]).alias("v"))))

    fields = let(payload_map(raw), known)
    return F.when(code.isNotNull(), F.create_map(F.lit("qr_code_barcode"), code)).when(raw == "", F.create_map().cast(MAP)).otherwise(fields)


def parse_payloads(payloads: Column) -> Column:
    """map of fields of several payloads: of each field the first that isn't empty."""
    maps = F.transform(payloads, lambda p: F.map_filter(parse_payload(p), lambda _, v: v != ""))
    return F.aggregate(maps, F.create_map().cast(MAP), lambda m, x: F.map_concat(m, F.map_filter(x, lambda k, _: ~F.map_contains_key(m, k))))


def is_structured(payloads: Column) -> Column:
    return F.exists(payloads, lambda p: F.contains(p, F.lit("=")) | p.rlike("^[0-9]{8,14}$"))


def with_absent(fields: Column, payloads: Column) -> Column:
    """If anything was decoded, payload fields that it doesn't give are known to be absent."""
    unset = F.map_from_arrays(F.array(*map(F.lit, PAYLOAD_KEYS)), F.array(*[F.lit(ABSENT)] * len(PAYLOAD_KEYS)))
    # the fields are worked out once, not anew for each key of the filter
    return let(fields, lambda m: F.when(F.size(payloads) > 0, F.map_concat(m, F.map_filter(unset, lambda k, _: ~F.map_contains_key(m, k)))).otherwise(m))


