import json

from pyspark.sql import functions as F

from brightloom.operators import evidence, extraction
from brightloom.sources import filings


class Forgetful(extraction.RuleClient):
    """Leaves out all but the first unit of a call, and quotes one thing that isn't there."""

    def extract(self, units):
        done, cards = super().extract(units[:1])
        return done, [{**c, "quote": "never said"} if "cash flow" in c["statement"] else c for c in cards] + [{"unit_id": "unknown", "statement": "x"}]


def tables(spark):
    units = spark.createDataFrame([("d", "d#u1", "Revenue rose 5%. Nothing here.\n\nOutlook is 7 units! cash flow 9"), ("d", "d#u2", "Demand was 3."), ("e", "e#u1", None)], "document_key string, unit_id string, unit string")
    batch = spark.createDataFrame([("d", "d#u1", 1, 1), ("d", "d#u2", 2, 1), ("e", "e#u1", 1, 1)], "document string, unit_id string, position int, batch int")
    return units, batch


def test_every_unit_is_called_for(spark):
    units, batch = tables(spark)
    for client in (extraction.RuleClient(), Forgetful()):
        cards, cover = extraction.extract_cards(units, batch, client)
        got = {(r["unit_id"], r["statement"], r["metric"], r["card_type"], r["backed"]) for r in cards.collect()}
        lie = isinstance(client, Forgetful)
        assert got == {("d#u1", "Revenue rose 5%.", "revenue", "fact", True), ("d#u1", "Outlook is 7 units!", "outlook", "guidance", True), ("d#u1", "cash flow 9", "cash flow", "fact", not lie), ("d#u2", "Demand was 3.", "demand", "fact", True)}
        assert {(r["document_key"], r["expected"], r["complete"]) for r in cover.collect()} == {("d", 2, True), ("e", 1, True)}
    cards, cover = extraction.extract_cards(units.limit(0), batch, extraction.RuleClient())
    assert cards.count() == cover.count() == 0


def test_the_client_s_reports():
    c = extraction.RuleClient()
    cards = [{"statement": "a 1"}, {"statement": "a 1"}, {"statement": "b 2"}]
    report = c.analyse(cards)
    assert report == "• a 1\n• b 2" and c.audit(report, cards) == {"unsupported_claims": []}
    audit = c.audit(report + "\n• c 3", cards)
    assert audit == {"unsupported_claims": ["c 3"]} and c.revise(report + "\n• c 3", audit) == report and c.is_update(1, 2) and not c.is_update(2, 2)


def test_adapters(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"source": "s", "source_id": "1", "ticker": "T", "title": "t", "published_at": "2026-06-01T00"}, {"source": "s", "source_id": "2", "ticker": "X"}, {"source": "s", "source_id": "3", "ticker": "T", "published_at": "2027-01-01"}, {"source": "s", "source_id": "4", "ticker": "T"}]))
    index = {"cik": "7", "fiscalYearEnd": "0930", "filings": {"recent": {"accessionNumber": ["a-1", "a-2", "a-3"], "filingDate": ["2026-06-01", "2026-06-02", "2026-01-01"], "reportDate": ["2026-03-31", "2026-06-02", "2025-12-31"], "form": ["10-Q", "8-K", "10-Q"], "items": ["", "2.02", ""], "primaryDocument": ["q.htm", "k.htm", "o.htm"]}}}
    (tmp_path / "i.json").write_text(json.dumps(index))
    files = spark.createDataFrame([("a-2", "8-K", "8-K", "https://f/k.htm"), ("a-2", "Release", "EX-99.1", "https://f/r_q1fy27.htm"), ("a-2", "x", "EX-10", "https://f/x.htm")], "accessionNumber string, description string, document_type string, url string")
    companies = spark.createDataFrame([("T", "7", "Talco")], "ticker string, cik string, name string")
    found = filings.discover_all([filings.FileAdapter(spark, str(tmp_path / "d.json")), filings.IndexAdapter(filings.read_index(spark, str(tmp_path / "i.json")), files)], companies, "2026-06-03")
    got = {(r["source"], r["source_id"]): (r["title"], r["fiscal_year"], r["quarter"], r["period_end"]) for r in found.collect()}
    assert got == {
        ("s", "1"): ("t", None, None, None), ("s", "4"): (None, None, None, None), ("sec_edgar", "a-1:q.htm"): ("Talco Form 10-Q — Form 10-Q", 2026, "Q2", "2026-03-31"), ("sec_edgar", "a-2:k.htm"): ("Talco Form 8-K — 8-K", 2026, "Q2", "2026-03-31"),
        ("sec_edgar", "a-2:r_q1fy27.htm"): ("Talco Form 8-K — Earnings Release / Exhibit EX-99.1 — r_q1fy27.htm", 2027, "Q1", "2026-03-31"),
    }
    assert found.schema.simpleString() == spark.createDataFrame([], filings.DISCLOSURE_SCHEMA).schema.simpleString() and filings.discover_all([], companies, "2026-06-03").count() == 0


def test_markup(spark):
    mark = lambda x: spark.createDataFrame([(x,)], "x string").select(evidence.report_markup(F.col("x")).alias("y")).first()["y"]
    assert mark("a<\n📈 關鍵指標:\n x|y & z \n\n🏢 業務部門: b>") == "a&lt;\n📈 關鍵指標:\n<pre>x|y &amp; z</pre>\n\n🏢 業務部門: b&gt;"
    assert mark("a<") == "a&lt;" and mark("📈 關鍵指標:\n<") == "📈 關鍵指標:\n&lt;" and mark(None) is None
