import random
import re

import pytest
from pyspark.sql import functions as F

from brightloom.llm import duplicates, survivors

SCHEMA = "record_kind string, id long, statement string, metric string, period string, _class string"
FIELDS = ["statement", "metric", "period"]


def brute(s):
    s = re.sub(r"(?<![^\W_])[-−‐‑](?=\$?\.?\d)", "\1", (s or "").upper().lower())
    s = re.sub(r"(?<![^\W\d_.])(?<!\.)\.(?=\d)", "\2", s)
    return "".join(c for c in s if c.isalnum() or c in "\1\2$%‰")


def groups_of(spark, rows):
    df = spark.createDataFrame([(k, i, s, m, p, "clash") for k, i, s, m, p in rows], SCHEMA)
    return {(r["record_kind"], r["first_id"]): r["copies"] for r in duplicates.groups(df, "record_kind", "id", FIELDS).collect()}


def test_same_and_not_same(spark):
    rows = [
        ("card", 5, "Up 4,752 sites, net.", "Net revenue", "Q1 FY2025"), ("card", 2, "«UP  4752\tsites NET»", "net_revenue", "(q1-fy2025)"),
        ("feed", 1, "Up 4,752 sites, net.", "Net revenue", "Q1 FY2025"),
        ("card", 7, "Up 47.52 sites, net.", "Net revenue", "Q1 FY2025"), ("card", 8, "Up -4752 sites net", "Net revenue", "Q1 FY2025"), ("card", 9, "up −4,752 sites; net", "Net revenue", "Q1 FY2025"),
        ("card", 10, None, None, None), ("card", 11, "", " ", "…"), ("card", 12, "5%", None, None), ("card", 13, "5‰", None, None),
    ]
    assert groups_of(spark, rows) == {("card", 2): 2, ("card", 8): 2, ("card", 10): 2}


def test_empty_and_hot_group(spark):
    assert groups_of(spark, []) == {}
    rows = [("card", i, f"same {' ' * (i % 7)}text", None, "") for i in range(600)] + [("card", 1000 + i, f"other {i}", None, None) for i in range(100)]
    assert groups_of(spark, rows) == {("card", 0): 600}


def test_classes_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BROADCAST_CLASSES", 1)
    monkeypatch.setattr(duplicates, "HEAVY_SHARE", 0.2)
    rows = [("card", i, "hot!" if i % 2 else f"pair {i // 4}", None, None) for i in range(200)]
    got = groups_of(spark, rows)
    assert got[("card", 1)] == 100 and len(got) == 51 and sum(got.values()) == 200


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Net", "revenue", "fell", "4,752", "47.52", "-3", "−3", "$5", "-$5", "5%", "a-b", "x.y", ".5", "Q1"]
    rows = [("card", i, rng.choice([" ", "\t", "  "]).join(rng.choice([str.upper, str.lower, str])(w) for w in rng.choices(words, k=3)) + rng.choice(["", ".", "!"]), rng.choice([None, "", "M"]), "p") for i in range(1500)]
    want = {}
    for _, i, s, m, p in rows:
        want.setdefault((brute(s), brute(m), brute(p)), []).append(i)
    assert groups_of(spark, rows) == {("card", min(v)): len(v) for v in want.values() if len(v) > 1}


def test_collapse_keeps_every_record(spark):
    rows = [("card", 1, "A b", None, None), ("card", 2, "a  B!", "", ""), ("card", 3, "c", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert {(r["first_id"], r["copies"]) for r in duplicates.collapse(df, "record_kind", "id", FIELDS).collect()} == {(1, 2), (3, 1)}


@pytest.mark.parametrize("payload", [
    '{"Metric":"M","PERIOD":null,"statement":"a | b: c"}', "statement=a | b: c | metric=M | period=", "Metric: M\nStatement: a | b: c\nPeriod: ", "  {\n \"period\": \"\", \"statement\": \"a | b: c\", \"metric\": \"M\"\n}",
])
def test_feed_notations(spark, payload):
    r = duplicates.feed_fields(spark.createDataFrame([(1, payload)], "feed_id long, payload string")).first()
    assert (r["statement"].strip(), r["metric"].strip(), (r["period"] or "").strip()) == ("a | b: c", "M", "")


def test_unreadable_payloads(spark):
    rows = duplicates.feed_fields(spark.createDataFrame([(1, None), (2, ""), (3, "{broken"), (4, "x" * 100_000)], "feed_id long, payload string")).collect()
    assert len(rows) == 4


CARD = "card_seq long, statement string, metric string, period string, document_key string, unit string, low double, midpoint double, high double, reported_change string, materiality_candidate int, extracted_at timestamp, source string"


def best(spark, rows):
    cards = spark.createDataFrame([(i, s, None, None, k, u, None, None, None, None, m, None, "wrong") for i, s, k, u, m in rows], CARD)
    if rows:
        cards = cards.withColumn("extracted_at", F.when(F.col("card_seq") == 4, F.timestamp_seconds(F.lit(5))))
    profile = spark.createDataFrame([("a", 9), ("b", 3)], "source string, trust_score int")
    return [(r["first_id"], r["survivor_id"], r["source"], r["materiality_candidate"]) for r in survivors.best_cards(cards, profile).orderBy("first_id").collect()]


def test_survivors(spark):
    rows = [
        (1, "one", "b:1", "USD", 2), (2, "ONE", "a:2", "", 9), (3, "one.", "a:3", None, None),  # trust first; the valid value from the next
        (4, "two", "a:1", "", 1), (5, "two", "a:2", "", 3), (6, "two", "zz:1", "u", 5),  # equal but for time
        (7, "three", "b:1", None, None), (8, "three", "b:2", None, 7), (9, "three", None, "u", 0),  # ties go to the smallest key
        (10, "alone", "a:1", None, 1),
    ]
    assert best(spark, rows) == [(1, 2, "a", 2), (4, 4, "a", 1), (7, 7, "b", None)]
    assert best(spark, []) == []
