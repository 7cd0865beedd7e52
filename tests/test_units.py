from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from brightloom.functions import numerals
from brightloom.operators import quantity_text as qt
from brightloom.operators import units

CARDS = "card_seq long, metric string, value_num double, value_text string, unit string, quote string, kind string, common_unit string"
CATALOG = [(1, "Net revenue", "money", "USD"), (2, "Copper purchased", "mass", "kg"), (3, "Gross margin", "ratio", "basis point"), (4, "Order lead time", "duration", "day"), (5, "Dividend per share", "per_share", "US cent per share")]
SCHEMA = "metric_id int, metric string, quantity_kind string, common_unit string"


def run(spark, rows):
    cards = spark.createDataFrame([(*r, "x", "y") for r in rows], CARDS)
    return {r["card_seq"]: r for r in units.normalise(cards, spark.createDataFrame(CATALOG, SCHEMA)).collect()}


def test_columns_and_quote(spark):
    got = run(spark, [
        (1, "Net revenue", 3.5, None, "$M", "Net revenue was shaped by mix."),
        (2, "net_revenue", None, "USD 0.07653B", None, "x"),
        (3, "Net revenue", 38510.0, None, "USD", "After $8,354 million a year earlier, net revenue reached $38,510 thousand."),
        (4, "Copper purchased", None, "10", "lbs", ""),
        (5, "Gross margin", None, "forty-five point two six percent", None, None),
        (6, "Order lead time", None, None, None, "Order lead time came to twelve weeks, compared with 9 days a year earlier."),
        (7, "Net revenue", 5.0, None, "USD", "We said before that net revenue depends on mix."),
        (8, "Net revenue", 5.0, None, None, "nothing"),
        (9, None, 5.0, None, "USD", "x"),
        (10, "No such metric", 5.0, None, "USD", "x"),
        (11, "Net revenue", None, "n/a", "USD", "(in thousands, except per share data) Net revenue (1,234)"),
        (12, "Dividend per share", None, "−$2.5 a share", "", None),
        (13, "Net revenue", float("nan"), "", " ", ""),
        (14, "Copper purchased", 1.0, None, "parsecs", ""),
        (15, "Net revenue", 9e13, None, "$B", ""), (16, "Net revenue", float("inf"), None, "USD", ""), (17, "Net revenue", 1e300, None, "USD", "x" * 50_000),
        (2, "net_revenue", None, "USD 0.07653B", None, "x"),
    ])
    value = {k: r["common_value"] for k, r in got.items()}
    assert value == {1: 3_500_000, 2: 76_530_000, 3: 38_510_000, 4: 5, 5: 4526, 6: 84, 7: 5, 11: -1_234_000, 12: -250}
    assert [k for k, r in got.items() if r["stated"]] == [7]


def test_half_away_from_zero(spark):
    got = run(spark, [(1, "Gross margin", 0.125, None, "%", None), (2, "Gross margin", -0.125, None, "%", None)])
    assert (got[1]["common_value"], got[2]["common_value"]) == (13, -13)


def test_long_numbers_are_exact(spark):
    got = run(spark, [
        (1, "Net revenue", 1e15, None, "USD", None), (2, "Net revenue", None, "-9,223,372,036,854,775,807", "USD", None), (3, "Net revenue", None, "1.2345678905", "$B", None),
        (4, "Net revenue", None, "9,223,372,036,854,775,808", "USD", None), (5, "Net revenue", None, "0.0000000004999999999", "$B", None), (6, "Net revenue", None, "9" * 5000, "USD", None), (7, "Copper purchased", None, "2,000,000,000,000,000,000,500", "g", None),
    ])
    assert {k: r["common_value"] for k, r in got.items()} == {1: 10**15, 2: -(2**63 - 1), 3: 1_234_567_891, 5: 0, 7: 2 * 10**18 + 1}


def test_empty(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("text,value", [("thirteen", 13), ("ninety-seven point zero two", Decimal("97.02")), ("one hundred and five", 105), ("two three", None), ("zero point five", Decimal("0.5"))])
def test_words(text, value):
    assert numerals.words_value(text) == value


@pytest.mark.parametrize("text,number,unit", [
    ("$(4.5) million", "-4.5", "$ million"), ("1 234 567 USD", "1234567", "usd"), ("c. 9", "9", ""), ("negative $13.06 a share", "-13.06", "$ a share"),
    ("a fraction of 0.8", "0.8", "fraction of"), ("9 sq. ft.", "9", "sq. ft"), ("Q4 result", None, None), ("", None, None), ("9 percent in the third quarter", "9", "percent"),
])
def test_read(text, number, unit):
    got = qt.read(text)
    assert got == (None if number is None else (Decimal(number), unit))


def test_long_text():
    assert qt.read("x" * 200_000 + " 5 kg") == (Decimal(5), "kg")


def _aliases(spark, rows):
    df = spark.createDataFrame(rows, "kind string, spelling string")
    return {(r["kind"], r["spelling"]): (r["num"], r["den"]) for r in units.alias_dictionary(df).collect()}


def test_every_name_is_its_own_alias(spark):
    names = units.vocabulary()
    got = _aliases(spark, [(k, n) for k, n, _, _ in names])
    assert {(k, n): (a, b) for k, n, a, b in names} == got


def test_misspelled_units(spark):
    got = _aliases(spark, [("power", "kilowats"), ("power", "megawatt s"), ("money", "millon dollars"), ("money", "mm $"), ("mass", "kilogrammes"), ("mass", "furlongs"), ("money", "")])
    assert got[("power", "kilowats")] == (1, 1) and got[("power", "megawatt s")] == (1000, 1) and got[("money", "millon dollars")] == (10**6, 1) and got[("money", "mm $")] == (10**6, 1)
    assert ("mass", "furlongs") not in got and ("money", "") not in got


@given(st.text("abkmusd $/.", max_size=12), st.text("abkmusd $/.", max_size=12))
def test_edit_cost_is_a_distance(a, b):
    assert units.edit_cost(a, a) == 0 and abs(units.edit_cost(a, b) - units.edit_cost(b, a)) < 1e-9
