import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.functions import text
from brightloom.operators import unitize

EVIDENCE = "evidence_id long, document_key string, title string, text string, structured_facts array<struct<concept: string, value: string>>, metadata struct<document_kind: string, raw_chars: int, truncated: boolean>"


def greedy(sizes, most, glue=0, items=None):
    out, g, size, n = [], 0, 0, 0
    for x in sizes:
        if n == 0 or size + x + glue > most or (items and n >= items):
            g, size, n = g + 1, x, 1
        else:
            size, n = size + x + glue, n + 1
        out.append(g)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), min_size=1, max_size=20))
def test_folds(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s array<int>")
    got = df.select("i", unitize.greedy_groups(F.col("s"), 40, 2).alias("a"), unitize.greedy_groups(F.col("s"), 40, 0, 2).alias("b")).collect()
    for r in got:
        assert r["a"] == greedy(rows[r["i"]], 40, 2) and r["b"] == greedy(rows[r["i"]], 40, 0, 2)


def units_of(spark, *rows):
    return unitize.units(spark.createDataFrame(list(rows), EVIDENCE), 100)


def test_units_cover_texts(spark):
    call = "\n\n".join(["Opening words."] * 9 + ["We will now begin the question-and-answer session."] + ["Question and answer."] * 9)
    filing = "Boilerplate text.\n\nRevenue rose 5%.\n\nMore boilerplate."
    rows = [
        (1, "s:1", "Call", call, [("Revenue", "5")], ("transcript", None, False)), (2, "s:2", "Form 10-Q", filing, [], (None, None, False)), (3, "s:3", "x", None, None, ("other", None, False)),
        (4, "s:4", "x", "y" * 350, [], ("other", None, True)), (5, "s:5", "Form 10-Q", "Only boilerplate.\n\nAnd more.", [], (None, None, None)),
    ]
    u = units_of(spark, *rows).orderBy("evidence_id", "position").collect()
    of = lambda k: [(r["position"], r["phase"], r["unit"]) for r in u if r["evidence_id"] == k]
    first = [x for x in of(1) if x[0] > 0]
    assert "\n\n".join(x[2] for x in first) == call and all(len(x[2]) <= 100 for x in first)
    assert [p for _, p, _ in first] == sorted([p for _, p, _ in first]) and {p for _, p, _ in first} == {"prepared_remarks", "qa"} and next(x for x in first if x[1] == "qa")[2].startswith("We will now")
    assert of(1)[0][:2] == (0, "structured_facts") and [x[2] for x in of(2)] == ["Revenue rose 5%."] and of(3) == [] and [len(x[2]) for x in of(4)] == [100, 100, 100, 50] and [x[2] for x in of(5)] == ["Only boilerplate."]
    m = {r["evidence_id"]: r for r in unitize.unit_manifest(spark.createDataFrame(rows, EVIDENCE), units_of(spark, *rows)).collect()}
    assert m[1]["qa_units"] > 0 and m[1]["units"] == len(of(1)) and m[4]["truncated"] and m[3]["units"] == 0


def test_batches_and_coverage(spark):
    u = units_of(spark, *[(i, f"s:{i}", "x", "\n\n".join(["word " * 18] * (i % 7)), [], ("other", None, False)) for i in range(20)])
    b = unitize.batches(u, most=150).collect()
    assert len(b) == u.count() == len({r["unit_id"] for r in b})
    ids = u.withColumn("d", F.lit(1)).select("d", "unit_id")
    c = unitize.coverage(ids, ids, ["d"]).first()
    assert c["ratio"] == 1.0 and c["complete"] and c["missing"] == 0
    c = unitize.coverage(ids, ids.limit(1).unionAll(spark.createDataFrame([(1, "odd")], "d int, unit_id string")), ["d"]).first()
    assert not c["complete"] and c["unexpected"] == 1 and c["missing"] == c["expected"] - 1
    assert not unitize.coverage(ids, ids, ["d"], ids).first()["complete"]


@pytest.mark.parametrize("n,slots,want", [(10, 3, [0, 4, 9]), (10, 1, [9]), (2, 3, [0, 1]), (0, 3, []), (5, 0, []), (6, 4, [0, 2, 3, 5])])
def test_even_samples(spark, n, slots, want):
    assert spark.range(1).select(unitize.even_sample(F.lit(n), slots).alias("x")).first()["x"] == want


def test_sections_and_groups(spark):
    e = spark.createDataFrame([(1, "s:1", "Earnings call", "\n\n".join(["Remarks. " * 700] * 9 + ["Questions and answers. " * 300] * 6), [], ("transcript", None, False)), (2, "s:2", "Q&A transcript", "short", [], ("qa", None, False))], EVIDENCE)
    s = unitize.sections(e)
    kinds = [r["kind"] for r in s.where("evidence_id = 1").orderBy("position").collect()]
    assert kinds == ["transcript"] * 9 + ["qa"] * 6 and s.where("evidence_id = 2").first()["kind"] == "qa"
    g = unitize.chosen_groups(s)
    assert g.where("evidence_id = 1").select("part", "grp").distinct().count() <= unitize.MOST_GROUPS and g.where("evidence_id = 2").count() == 1


def test_pages(spark):
    pages = ["texts", "revenue guidance margin", "", "revenue", "x", "We will now take questions", "answer"]
    df = spark.createDataFrame([(pages,)], "p array<string>")
    assert df.select(unitize.best_pages(F.col("p"), 2, 1).alias("x")).first()["x"] == [0, 1, 3]
    assert df.select(unitize.bounded_join(F.col("p"), 12).alias("x")).first()["x"] == "texts\n\nreven"
    call = df.select(unitize.compress_call(F.col("p"), 200).alias("x")).first()["x"]
    assert call.index("[[PAGE 6]]") < call.index("[[PAGE 1]]") and len(call) <= 200
    assert len(df.select(unitize.compress_document(F.col("p"), 20).alias("x")).first()["x"]) <= 20
    assert df.select(unitize.pseudo_pages(F.lit("a\n\nb\n\nc"), 2).alias("x")).first()["x"] == ["a\n\nb", "c"]
    short = lambda said, kind, title: spark.createDataFrame([(said, kind, title)], "s string, k string, t string").select(unitize.compress(F.col("s"), F.col("k"), F.col("t")).alias("x")).first()["x"]
    assert short("Hello there. Revenue rose.", "filing", None) == "Revenue rose." and short("Hello there.", None, None) == "Hello there." and short(None, None, None) == ""
    assert short("Hello there. Revenue rose.", "filing", "Earnings call").startswith("[[PAGE 1]]") and short("Hello.", "qa", None) == "[[PAGE 1]]\nHello."
