"""Text, number, price and identifier functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ABSENT, INFO_WORDS

# Patterns that decide what counts as a price, a code and so on.
PRICE = r"(?<![0-9./-])([0-9]{1,5})\s*[.,]\s*([0-9]{2})(?![0-9./-])"
PRICE_SPACED = r"(?<![0-9])([0-9]{1,5})\s+([0-9]{2})(?![0-9])"
PRICE_COMPACT = r"(?<![0-9])([0-9]{3,7})(?![0-9])"
SOME_PRICE = r"[0-9]\s*[.,]?\s*[0-9]{2}"  # what any of the three has
UNIT = r"(?iu)(?:л|l|литр|мл|ml|кг|kg|гр|г)(?![а-яa-z])"
CURRENCY = r"(?iu)(?:руб|₽|коп)"
ID_LIKE = r"(?iu)(?:штрих|barcode|баркод|артикул|sku|id[_\s-]*sku|qr|код)"
DISCOUNT = r"([0-9]{1,3})\s*%"
PRINTED = r"([0-9]{2}[./-][0-9]{2}[./-][0-9]{4}\s+[0-9]{1,2}:[0-9]{2})"
ZONE = r"([0-9]{2}_[0-9]{6}\s*-\s*[0-9]{6})"
EAN_RUN = r"(?<![0-9])([0-9]{8,14})(?![0-9])"
SKU_RUN = r"(?<![0-9])([0-9]{9,13})(?![0-9])"
SPECIAL = r"(?U)(?:^|\s)([ШшКкЛл])(?:\s|$)"
NOT_PRODUCT = r"(?iu)(руб|коп|цена|скид|карте|штрих|артикул|qr|код|дата|печати|итого|%|₽)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_text(x: Column) -> Column:
    """No-break spaces and runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


def normalize_for_similarity(x: Column) -> Column:
    lower = F.replace(F.lower(normalize_text(F.coalesce(x, F.lit("")))), F.lit("ё"), F.lit("е"))
    return normalize_text(F.regexp_replace(lower, r"[^0-9a-zа-я]+", " "))


def canonical(x: Column) -> Column:
    """Normalised text; the word for "absent", in Greek look-alikes too, to its one form."""
    t = normalize_text(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t).isin("нет", "νες", "νετ"), F.lit(ABSENT)).otherwise(t)


def present(x: Column) -> Column:
    """The trimmed value, or null if it is blank or known to be absent."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when((t != "") & (t != ABSENT), t)


def filled(x: Column) -> Column:
    """Whether a value says something: none of blank, nan, none, "absent", in any case."""
    return ~F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))).isin("", "nan", "none", ABSENT)


def two_decimals(x: Column) -> Column:
    """A double with two decimals, rounded half-even on its exact value."""
    return F.call_function("format_number", x, F.lit("0.00"))


def one_decimal(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0")).cast("double")


def price_to_str(x: Column) -> Column:
    """First price-like number of a text with two decimals; the trimmed text if there is none."""
    s = F.replace(F.replace(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit(" ")), F.lit("₽")), F.lit(","), F.lit("."))
    whole, part = F.regexp_extract(s, r"([0-9]{1,5})(?:\.([0-9]{1,2}))?", 1), F.regexp_extract(s, r"([0-9]{1,5})(?:\.([0-9]{1,2}))?", 2)
    found = F.concat(F.when(whole != "", whole).cast("int").cast("string"), F.lit("."), F.rpad(part, 2, "0"))
    return F.when((s == "") | F.lower(s).isin("nan", "none"), F.lit("")).otherwise(F.coalesce(found, F.trim(x)))


def smart_float(x: Column) -> Column:
    """A number from text, however it is written; NaN if there is none."""
    s = F.replace(F.translate(F.trim(x), "  ", ""), F.lit(","), F.lit("."))
    first = F.replace(F.regexp_extract(x, r"(-?[0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit("."))
    nan = F.lit(float("nan"))
    number = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).otherwise(first)
    return F.when(x.isNull() | F.lower(s).isin("", "nan", "none", ABSENT), nan).otherwise(F.coalesce(number.try_cast("double"), nan))


def smart_int(x: Column) -> Column:
    f = smart_float(x)
    return F.when(F.isnan(f), F.lit(0)).otherwise(F.rint(f)).cast("long")


def ean13_is_valid(x: Column) -> Column:
    d = F.regexp_replace(x, "[^0-9]", "")
    at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + at(i) * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(F.length(d) == 13, (10 - total % 10) % 10 == at(F.lit(13))).otherwise(F.lit(False))


def barcodes(text: Column) -> Column:
    """The valid EAN-13 codes among runs of digits."""
    return F.filter(F.regexp_extract_all(text, F.lit(EAN_RUN), F.lit(1)), ean13_is_valid)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct(a, b, g1..)>: start, end and groups of each match, in order."""
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    # what lies between matches gives their places
    names = ["before", "hit", *(f"g{i + 1}" for i in range(groups))]
    zipped = F.arrays_zip(F.split(text, pattern).alias("before"), *(part(i).alias(n) for i, n in enumerate(names[1:])))
    zipped = F.filter(F.transform(zipped, lambda z: F.struct(*(z[n].alias(n) for n in names))), lambda z: z["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<a:int,b:int{''.join(f',g{i + 1}:string' for i in range(groups))}>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        a = s["at"] + F.length(z["before"])
        b = a + F.length(z["hit"])
        one = F.struct(a.alias("a"), b.alias("b"), *(z[f"g{i + 1}"].alias(f"g{i + 1}") for i in range(groups)))
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(start["out"])


def around(text: Column, a: Column, b: Column, before: int, after: int) -> Column:
    first = F.greatest(F.lit(0), a - before)
    return F.substring(text, first + 1, F.least(F.length(text), b + after) - first)


def with_price(prices: Column, whole: Column, cents: Column, context: Column) -> Column:
    """prices with one more, if its context allows it and it isn't there yet."""
    price = F.concat(whole.cast("int").cast("string"), F.lit("."), F.substring(cents, 1, 2))
    ok = ((whole.cast("int") >= 2) | context.rlike(CURRENCY)) & ~context.rlike(ID_LIKE)
    return F.when(ok & ~F.array_contains(prices, price), F.concat(prices, F.array(price))).otherwise(prices)


def find_prices(raw: Column) -> Column:
    """Prices of a text: decimal ones, then spaced and compact ones where no earlier match lies."""
    return let(normalize_text(raw), prices_in)


def prices_in(text: Column) -> Column:
    spans = "array<struct<a:int,b:int>>"
    state = F.struct(F.array().cast("array<string>").alias("p"), F.array().cast(spans).alias("o"))
    unit = lambda m: around(text, m["a"], m["b"], 4, 5).rlike(UNIT)
    near = lambda m: around(text, m["a"], m["b"], 18, 18)
    free = lambda s, m: ~F.exists(s["o"], lambda o: (m["b"] > o["a"]) & (m["a"] < o["b"]))
    taken = lambda s, m: F.concat(s["o"], F.array(F.struct(m["a"].alias("a"), m["b"].alias("b"))))
    make = lambda p, o: F.struct(p.alias("p"), o.alias("o"))

    def decimal(s: Column, m: Column) -> Column:
        return make(F.when(unit(m), s["p"]).otherwise(with_price(s["p"], m["g1"], m["g2"], near(m))), taken(s, m))

    def spaced(s: Column, m: Column) -> Column:
        more = with_price(s["p"], m["g1"], m["g2"], near(m))
        skip = ~free(s, m) | ((F.length(m["g1"]) == 1) & (m["g1"].cast("int") < 2))
        return F.when(skip, s).when(unit(m), make(s["p"], taken(s, m))).when(F.size(more) > F.size(s["p"]), make(more, taken(s, m))).otherwise(s)

    def compact(s: Column, m: Column) -> Column:
        raw_ = m["g1"]
        side = F.concat(around(text, m["a"], m["a"], 1, 0), around(text, m["b"], m["b"], 0, 1))
        skip = ~free(s, m) | (F.length(raw_) < 4) | raw_.startswith("0") | side.rlike(r"[.,/:;-]") | unit(m) | near(m).rlike(r"[0-9]{1,2}[./-][0-9]{1,2}|:")
        return F.when(skip, s).otherwise(make(with_price(s["p"], F.substring(raw_, F.lit(1), F.length(raw_) - 2), F.right(raw_, F.lit(2)), near(m)), s["o"]))

    state = F.aggregate(matches(text, PRICE, 2), state, decimal)
    state = F.aggregate(matches(text, PRICE_SPACED, 2), state, spaced)
    return F.aggregate(matches(text, PRICE_COMPACT, 1), state, compact, lambda s: s["p"])


def find_prices_in_lines(lines: Column, full: Column) -> Column:
    """Prices of the full text, then those whose two parts stand on neighbouring lines."""
    texts = F.filter(F.transform(lines, normalize_text), lambda t: t != "")
    n = F.greatest(F.size(texts) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(texts, F.lit(1), n), F.slice(texts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda x: x["a"].rlike("^[0-9]{1,5}$") & x["b"].rlike("^[0-9]{2}$"))
    return F.aggregate(pairs, find_prices(full), lambda p, x: with_price(p, x["a"], x["b"], F.concat_ws(" ", x["a"], x["b"])))


def product_lines(lines: Column) -> Column:
    """Lines that may name a product."""

    def ok(t: Column) -> Column:
        digits, letters = F.regexp_count(t, F.lit(r"\p{Nd}")), F.regexp_count(t, F.lit(r"\p{L}"))
        plain = ~t.rlike(NOT_PRODUCT) & ~t.rlike(PRINTED) & ~t.rlike(ZONE)
        cheap = (F.length(t) >= 5) & t.rlike("[А-Яа-яЁё]") & plain & (letters >= 3) & (digits <= F.greatest(F.lit(5), letters))
        # most lines have no digits next to each other or in decimals, and so no price
        return F.when(cheap & t.rlike(SOME_PRICE), F.size(find_prices(t)) == 0).otherwise(cheap)

    return let(F.transform(lines, normalize_text), lambda ts: F.filter(ts, ok))


def clean_product_name(x: Column) -> Column:
    return F.btrim(F.regexp_replace(normalize_text(x), r"^[^A-Za-zА-Яа-яЁё]+", ""), F.lit(" -;,.|_"))


def info_words(text: Column) -> Column:
    """Known words found in a text, in their fixed order; null if there is none."""
    low = F.lower(text)
    found = F.filter(F.array(*map(F.lit, INFO_WORDS)), lambda w: F.contains(low, w))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def first_group(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    x = F.regexp_extract(text, pattern, 1)
    return F.when(x != "", x)
