import json
from datetime import date, datetime

from pyspark.sql import functions as F

from brightloom.operators import evidence


def test_matching(spark):
    e = spark.createDataFrame([("T1", "T", 2026, "Q1", "2026-03-31"), ("T2", "T", 2026, "Q2", None), ("T2b", "T", 2026, "Q2", None), ("U1", "U", 2026, "Q4", "2026-12-31")], "event_id string, ticker string, fiscal_year int, quarter string, period_end string")
    c = spark.createDataFrame([(1, "T", "Q1 2026 slides", None), (2, "T", "Q2 2026 slides", None), (3, "U", "Presentation of 2027-01-20", date(2027, 1, 10)), (4, "U", "Presentation of 2027-01-20", date(2027, 3, 1)), (5, None, "Q1 2026", None), (6, "U", "earnings 2027-01-16", date(2027, 1, 10)), (7, "U", "earnings 2027-01-20", date(2027, 1, 10)), (8, "U", "slides 2027-01-10", date(2027, 1, 10)), (9, "U", None, date(2027, 1, 10)), (10, "T", "Presentation of 2027-01-20", date(2027, 1, 20))], "k int, ticker string, said string, day date")
    assert {(r["k"], r["event_id"]) for r in evidence.match_events(c, e, "k", "ticker", "said", "day").collect()} == {(1, "T1"), (3, "U1"), (6, "U1")}
    assert evidence.match_events(c.limit(0), e, "k", "ticker", "said", "day").count() == evidence.match_events(c, e.limit(0), "k", "ticker", "said", "day").count() == 0


def test_budgets_and_samples(spark):
    df = spark.createDataFrame([("a", 1, "x" * 6), ("a", 2, "y" * 6), ("a", 3, "z"), ("b", 1, None)], "k string, n int, t string")
    assert sorted((r["n"], len(r["t"] or "")) for r in evidence.within_budget(df, ["k"], [F.col("n")], "t", 10).where("k = 'a'").collect()) == [(1, 6), (2, 4)]
    assert sorted(len(r["t"] or "") for r in evidence.equal_share(df, ["k"], "t", 9).collect()) == [0, 1, 3, 3]
    pick = lambda n: spark.range(1).select(evidence.positions_sample(F.lit(n)).alias("x")).first()["x"]
    assert pick(4) == [0, 1, 2, 3] and pick(12) == [0, 1, 4, 6, 8, 10, 11] and pick(0) == []


def test_related(spark):
    u = spark.createDataFrame([(1, "a", 1, "backlog rose"), (1, "b", 2, "the Backlog"), (1, "c", 3, "none"), (2, "d", 1, "backlog")], "doc int, unit_id string, position int, unit string")
    got = {r["unit_id"]: r["related"] for r in evidence.related_units(u, "doc", F.nullif(F.regexp_extract(F.lower("unit"), "(backlog)", 1), F.lit(""))).collect()}
    assert got == {"a": ["b"], "b": ["a"], "d": []}


def test_sources(spark):
    d = spark.createDataFrame([(1, "e", "T [XBRL]", "u", (None,)), (2, "e", "T", "u", (None,)), (3, "e", "X", "u", ("ixbrl",))], "n int, event_id string, title string, url string, metadata struct<format: string>")
    assert [r["n"] for r in evidence.report_sources(d, ["event_id"], [F.col("n")]).collect()] == [1]
    a = spark.createDataFrame([("T", True), ("T", False), ("U", False), ("V", True)], "t string, ok boolean")
    assert {r["t"]: r["status"] for r in evidence.collection_status(a, "t", "ok").collect()} == {"T": "partial", "U": "failed", "V": "checked"}
    answer = "```json\n" + json.dumps({"sources": [{"url": "https://ir.a.x/1", "title": "t", "document_kind": "qa"}, {"url": "https://IR.a.x/1", "document_kind": "qa"}, {"url": "https://b.x", "document_kind": "qa"}, {"url": "https://a.x", "document_kind": "blog"}, {"url": None}]}) + "\n```"
    g = evidence.grounded_sources(spark.createDataFrame([(1, answer, ["a.x"]), (2, "no json", ["a.x"]), (3, None, None)], "k int, answer string, hosts array<string>"), "k", "answer", "hosts")
    assert [(r["at"], r["rejected"]) for r in g.orderBy("at").collect()] == [(0, None), (1, "repeated"), (2, "other_host"), (3, "unknown_kind"), (4, "no_link")]
    t = spark.createDataFrame([("e", 1, False), ("e", 2, True), ("e", 3, True), ("f", 1, False)], "e string, r int, ok boolean")
    assert {(r["e"], r["used_rank"], r["attempts"]) for r in evidence.first_success(t, ["e"], "r", "ok").collect()} == {("e", 2, 2), ("f", None, 1)}


def test_reports(spark):
    df = spark.createDataFrame([("[M3|B] • Claim: up | Evidence: call [Risk] end",)], "x string")
    assert df.select(evidence.clean_report(F.col("x")).alias("y")).first()["y"] == "• up；證據：call end"
    said = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert said(" └ Weak Link: none\nx", evidence.clean_report) == "└ 尚未確認: none\nx" and said(None, evidence.clean_report) == ""
    assert said("🏢 業務部門 / 客戶ROI: a", evidence.report_headers) == "🏢 業務部門:\n└ 客戶/ROI: a"
    assert said("a\n\n🎙️ 法說 Q&A: b\nc\n\n⚖️ d", evidence.without_call_section) == "a\n\n⚖️ d" and said("a\n\n🎙️ 法說Q&A：b", evidence.without_call_section) == "a" and said("a", evidence.without_call_section) == "a"
    docs = spark.createDataFrame([(1, "e", "A & B [XBRL]", "u?a=1&b", (None,)), (2, "e", "A & B", "u?a=1&b", (None,)), (3, "e", "x", None, (None,)), (4, "e", "y", "z", ("ixbrl",))], "n int, k string, title string, url string, metadata struct<format: string>")
    bodies = spark.createDataFrame([("e", " Body 😀 "), ("f", None), ("g", "x" * 4000)], "k string, body string")
    got = {r["k"]: r for r in evidence.composed(bodies, docs, "k", "body", [F.col("n")]).collect()}
    assert got["e"]["message"] == 'Body 😀\n\n資料來源:\n• <a href="u?a=1&amp;b">A &amp; B</a>\n• <a href="">x</a>' and got["e"]["units"] == len(got["e"]["message"]) + 1 and got["e"]["fits"]
    assert got["f"]["message"] == "\n\n資料來源:\n" and not got["g"]["fits"] and evidence.composed(bodies.limit(0), docs, "k", "body", [F.col("n")]).count() == 0
    a = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2)), (3, datetime(2026, 1, 2, 12))], "n int, at timestamp").withColumn("g", F.lit(1))
    assert [r["n"] for r in evidence.last_hours(a, "at", F.lit(datetime(2026, 1, 2, 6)), 24, ["g"], 5).collect()] == [2]
