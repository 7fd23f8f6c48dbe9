"""Prices in made-up texts whose prices are known from how they were made."""

import random

from pyspark.sql import functions as F

from tagloom.functions import text as t

#: Long enough that neighbours' words don't count, and without letters that could be a unit.
GAP = " " + "а" * 20 + " "


def piece(rng):
    """Kind, spelling and price (None where the surroundings rule it out)."""
    whole, cents = rng.randint(2, 99999), rng.randint(0, 99)
    price = f"{whole}.{cents:02d}"
    kind = rng.choice(["decimal", "spaced", "compact", "small", "rouble", "volume", "code", "word", "date"])
    if kind == "decimal":
        return kind, f"{whole}{rng.choice([',', '.', ' , ', ', '])}{cents:02d}", price
    if kind == "spaced":
        return kind, f"{whole} {cents:02d}", price
    if kind == "compact":
        whole = rng.randint(10, 99999)
        return kind, f"{whole}{cents:02d}", f"{whole}.{cents:02d}"
    if kind == "small":
        return "decimal", f"1,{cents:02d}", None
    if kind == "rouble":
        return "decimal", f"1,{cents:02d} руб", f"1.{cents:02d}"
    if kind == "volume":
        return "decimal", f"{rng.randint(2, 9)},{cents:02d} {rng.choice(['л', 'кг', 'мл', 'L'])}", None
    if kind == "code":
        return "decimal", f"{rng.choice(['штрих', 'SKU', 'qr'])} {whole},{cents:02d}", None
    if kind == "date":
        return "compact", f"12:05 {rng.randint(1000, 9999)}", None
    return "word", rng.choice(["сыр", "хит", "3", "12"]), None


def test_prices_by_kind_then_place(spark):
    rng, rows = random.Random(11), []
    for _ in range(400):
        made = [piece(rng) for _ in range(rng.randint(0, 5))]
        want = []
        for kind in ("decimal", "spaced", "compact"):
            want += [p for k, _, p in made if k == kind and p is not None and p not in want]
        rows.append((GAP.join(s for _, s, _ in made), want))
    df = spark.createDataFrame(rows, "text string, want array<string>")
    bad = df.withColumn("got", t.find_prices(F.col("text"))).where("got <> want").collect()
    assert not bad, bad[:3]


def test_two_lines_make_a_price(spark):
    df = spark.createDataFrame([(["129", "99"],), (["129", "9"],), (["129 99", " "],), (["1", "50"],), ([],)], "lines array<string>")
    got = [r[0] for r in df.select(t.find_prices_in_lines(F.col("lines"), F.array_join("lines", "|"))).collect()]
    assert got == [["129.99"], [], ["129.99"], [], []]
