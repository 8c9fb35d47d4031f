"""Masses, prices and currencies in titles, and the unit classifier on held-out rows."""

import random

import pytest
from pyspark.sql import functions as F

from siderite.functions import units as parse
from siderite.operators import units

MASSES = {
    "2 kg": 2000, "500 mg": 0.5, "1 oz": 28.349523125, "2 kilograms": 2000, "A 12.5 g": 12.5, "12,5 g.": 12.5, "0,98g": 0.98, "1 047 g": 1047, "1,047 g": 1047, "1,047 kilo": 1047, "1.058 oz (30 g)": 29.99379546625,
    "4 lb 8.5 oz": 4 * 453.59237 + 8.5 * 28.349523125, "[126ct]": 25.2, "A 1.5-2 g": None, "3-4 g": None, "NVP 9895": None, "18 g (TKW 898 kg)": 18, "3g, TKW 188 kg": 3, "18.5 gm of 797 kg total known weight": 18.5,
    "TKW 5 kg": None, "m0unt x 3 gramos": 3, "QsB 714 123 g": 123, "#12 g": None, "": None, None: None, "  31.4  grams": 31.4, "1.234,5 g": 1234.5, "1,234.5 g": 1234.5, "0 g": None, "x " * 5000 + "7 g": 7,
}


def test_title_masses(spark):
    rows = parse.with_title_mass(spark.createDataFrame([(t,) for t in MASSES], "title string")).collect()
    got = {r["title"]: r["title_mass_g"] for r in rows}
    for title, want in MASSES.items():
        assert got[title] == (None if want is None else pytest.approx(want)), title


def test_currencies(spark):
    cases = {"$": ("USD", 1), " USD": ("USD", 1), "€ ct": ("EUR", 0.01), "pence": ("GBP", 0.01), "Fr.": ("CHF", 1), "zł": ("PLN", 1), "¥": ("JPY", 1), "shells": (None, 1), None: (None, 1)}
    rows = parse.with_currency(spark.createDataFrame([(c,) for c in cases], "c string"), "c").collect()
    assert {r["c"]: (r["currency_code"], r["currency_scale"]) for r in rows} == cases
    titles = {"slice US$ 65, 3 g": "US$", "€8": "€", "23.99 Euro": "Euro", "0.6 pounds": None, "C$385": "C$", "JPY 300": "JPY", None: None}
    found = spark.createDataFrame([(t,) for t in titles], "t string").select("t", parse.title_currency(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in found} == titles


def test_notes(spark):
    cases = {"all masses in avoirdupois ounces": "oz", "in kilograms throughout": "kg", "come in carats (0.2 g)": "ct", "masses are pounds": "lb", "durchgehend in Milligramm": "mg", "Gewichte in Gramm": "g", "Lots are rejected.": "g", None: "g"}
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", parse.note_unit(F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in got} == cases


SCHEMA = "id string, source string, title string, canonical_name_status string, price double, currency string, weight_g double, price_usd double, fx_rate_date string, meteorite_type string, unit double"
SOURCES = "name string, notes string, unit int"
RATES = "rate_date string, currency string, rate_to_usd double, provider string, published_at timestamp"


def inputs(spark, n=900):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source, factor = rng.choice([("gram shop", 1.0), ("ounce shop", 28.349523125), ("milli shop", 0.001)])
        mass = round(rng.uniform(1, 300), 1)
        title = f"Rock {i} {mass} g" if i % 3 else f"Rock {i} slice"
        rows.append((f"i{i}", source, title, "unknown", mass * 2, "EUR", mass / factor, mass * 2 * 1.1, "2026-05-01", "iron", 9.0))
    rows += [("null", None, None, None, None, None, None, None, None, None, None), ("x1", "gram shop", "Rock 5 g", "unknown", 10.0, "EUR", 5000.0, 10.0, "2026-05-01", "iron", 1.0), ("x1", "gram shop", "Rock 5 g", "unknown", 10.0, "EUR", 5000.0, 10.0, "2026-05-01", "iron", 1.0), ("nan", "gram shop", "Rock", "unknown", 1.0, "shells", float("nan"), 1.0, "2026-05-01", None, 1.0)]
    sources = [("gram shop", "Gram weights", 1), ("ounce shop", "every mass in ounces", 1), ("milli shop", "Milligramm", 1), ("gram shop", "Gram weights", 2), ("idle", None, 1)]
    rates = [("2026-05-01", "EUR", 1.1, "open board", None), ("2026-05-01", "EUR", 1.1, "open board", None), ("2026-05-01", "EUR", 9.9, "other", None)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sources, SOURCES), spark.createDataFrame(rates, RATES)


def test_missing_units_are_predicted_and_wrong_values_found(spark):
    out = units.common_units(*inputs(spark)).cache()
    assert out.count() == 904
    silent = out.where("mass_basis IN ('predicted', 'review')")
    assert silent.where("mass_basis = 'predicted'").count() > 0.9 * silent.where("NOT isnan(weight_g)").count()
    found = {tuple(r) for r in units.wrong_values(out).collect()}
    want = {(r["id"], "weight_g") for r in out.where("source IN ('ounce shop', 'milli shop')").collect()} | {("x1", "weight_g"), ("x1", "price_usd")}
    assert found == want


def test_predictions_decide_and_uncertain_rows_are_routed(spark, monkeypatch):
    listings, sources, rates = inputs(spark)
    parsed, model = units.parsed_and_fitted(listings, sources)
    sure = units.convert(parsed, model, rates).where("mass_basis = 'predicted'")
    # the forest has learned ounces from the titles, so it converts them also where the notes say nothing
    silent = units.convert(parsed.withColumn("note_unit", F.lit("g")), model, rates).where("source = 'ounce shop' AND mass_basis = 'predicted'")
    assert sure.count() > 0 and sure.where("abs(mass_g - rule_g) > 0.01 * rule_g").count() == 0
    assert silent.where("abs(mass_g - weight_g) < 0.01 * weight_g").count() == 0 or silent.count() == 0
    monkeypatch.setattr(units, "CONFIDENT", 1.1)  # nothing is certain
    routed = units.convert(parsed, model, rates)
    assert routed.where("mass_basis = 'predicted'").count() == 0 and routed.where("mass_basis = 'review' AND mass_g IS NOT NULL").count() == 0
    assert routed.where("mass_basis = 'review' AND weight_g IS NOT NULL AND rule_g IS NULL").count() == 0
    monkeypatch.undo()
    told = {r["measure"]: r["value"] for r in model.measured().collect()}
    assert told["rows"] > 0 and told["accuracy"] > 0.95 and told["calibration_error"] < 0.05


def test_held_out_accuracy(spark):
    listings, sources, _ = inputs(spark, 1500)
    parsed = units.parsed_listings(listings, sources).cache()
    model = units.UnitModel.fit(parsed, 400, 200)
    scored = model.predict(units._labelled(parsed)).where("confidence >= 0.9")
    right = scored.where(F.col("unit") == F.element_at(F.array(*[F.lit(u) for u in units.UNITS]), F.col("label") + 1)).count()
    assert scored.count() > 800 and right / scored.count() > 0.97


def test_empty_tables(spark):
    listings, sources, rates = inputs(spark, 5)
    assert units.common_units(listings.limit(0), sources, rates).count() == 0
    alone = units.common_units(listings, sources.limit(0), rates.limit(0))
    assert alone.count() == 9 and alone.where("usd IS NOT NULL").count() == 0
