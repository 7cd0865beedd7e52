import io
import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from brightloom.sources import filings, markup
from brightloom.streaming import state

PAGE = """<html><head><title>T &amp; co</title><meta property="og:description" content="D"><script type="application/ld+json">{"datePublished": "2026-01-02"}</script></head><body><nav>menu</nav>
<h2>Second quarter</h2><ul><li>Results <a href="/q2.pdf">Earnings release</a> here</li></ul><p><a href="#x"></a></p><script>var a = "https:\\/\\/cdn.example\\/deck.pdf?v=1";</script>
<table class="tableFile"><tr><th>n</th></tr><tr><td>1</td><td>Exhibit</td><td><a href="e.htm">e.htm</a></td><td>ex-99.1</td></tr><tr><td>2</td><td>pic</td><td><a href="p.jpg">p</a></td><td>GRAPHIC</td></tr></table>
<ix:nonFraction name="us:Revenues" contextRef="c1" unitRef="usd" scale="6">1,<b>234</b></ix:nonFraction><ix:nonFraction name="us:Foo">9</ix:nonFraction></body>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://ir.example/a/", PAGE), (2, "https://ir.example/q2.pdf", "<a href='/z.txt'>deep</a>"), (3, "u", None), (4, "u", "<p><b>never closed")], "page_id long, url string, html string")
    links = markup.links(pages)
    got = {(r["page_id"], r["target"]): r for r in links.collect()}
    assert "Second quarter" in got[(1, "https://ir.example/q2.pdf")]["context"] and "Earnings release" in got[(1, "https://ir.example/q2.pdf")]["context"] and got[(1, "https://cdn.example/deck.pdf?v=1")]["kind"] == "script"
    assert {(r["page_id"], r["target"], r["hop"]) for r in markup.crawl_once(pages, links).collect()} >= {(1, "https://ir.example/z.txt", 1), (1, "https://ir.example/q2.pdf", 0)}
    assert [tuple(r) for r in markup.attachment_rows(pages).collect()] == [(1, "Exhibit", "EX-99.1", "https://ir.example/a/e.htm")]
    meta = {r["page_id"]: r for r in markup.page_metadata(pages).collect()}
    assert (meta[1]["published"], meta[1]["title"], meta[1]["description"]) == ("2026-01-02", "T & co", "D") and meta[3]["published"] is None
    text = {r["page_id"]: r["text"] for r in markup.page_text(pages).collect()}
    assert "menu" not in text[1] and "Second quarter" in text[1] and text[4] == "never closed" and text[3] == ""


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return b.getvalue()


def test_files(spark):
    xbrl = zipped({"a.xml": '<r xmlns:u="x"><u:NetIncome contextRef="c" unitRef="usd" decimals="-6">5</u:NetIncome><u:Odd contextRef="c">1</u:Odd></r>', "b.xml": "<broken"})
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = zipped({
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><R Id="r1" Target="worksheets/s.xml"/></R>', "xl/sharedStrings.xml": f'<sst xmlns="{ns}"><si><t>Revenue</t></si></sst>',
        "xl/worksheets/s.xml": f'<worksheet xmlns="{ns}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c><v>9</v></c></row></sheetData></worksheet>',
    })
    files = spark.createDataFrame([("x", bytearray(xbrl)), ("s", bytearray(sheet)), ("p", bytearray(PAGE.encode())), ("t", bytearray(b"plain text")), ("d", bytearray(b"%PDF-1.7")), ("z", bytearray(b"PKbroken")), ("n", None)], "path string, content binary")
    got = {(r["path"], r["concept"], r["value"]) for r in markup.facts(files).collect()}
    assert got == {("x", "NetIncome", "5"), ("p", "us:Revenues", "1, 234")}
    kinds = {r["path"]: (r["kind"], r["text"]) for r in markup.extract(files).collect()}
    assert kinds["s"] == ("spreadsheet", "[S] Revenue | 7") and kinds["t"] == ("text", "plain text") and kinds["d"][0] == "pdf" and kinds["n"] == ("text", "") and kinds["p"][0] == "page"


def test_filing_index(spark, tmp_path):
    data = {"cik": "1", "fiscalYearEnd": "0131", "filings": {"recent": {
        "accessionNumber": ["a1", "a2", "a3"], "filingDate": ["2026-06-01", "2026-06-02", "2026-01-01"], "reportDate": ["2026-05-03", "2026-06-01"], "form": ["10-Q", "8-K", "10-K"], "items": ["", "2.02,9.01", ""], "primaryDocDescription": ["", "Q3 2026", ""]}}}
    (tmp_path / "i.json").write_text(json.dumps(data))
    r = filings.records(filings.read_index(spark, str(tmp_path / "i.json")))
    assert [(x["form"], x["reportDate"]) for x in r.orderBy("seq").collect()] == [("10-Q", "2026-05-03"), ("8-K", "2026-06-01"), ("10-K", "")]
    kept = filings.with_report_period(filings.in_window(r, "2026-06-03"))
    assert {(x["form"], x["quarter"], x["fiscal_year"]) for x in kept.collect()} == {("10-Q", "Q1", 2027), ("8-K", "Q3", 2027)}
    rows = [("c", "0930", n, form, f"{end}", "2026-01-01", "") for n, (form, end) in enumerate([("10-K", "2025-09-30"), ("10-Q", "2025-10-31"), ("10-Q", "2025-12-31"), ("10-Q", ""), ("8-K", "2026-01-01"), ("20-F", "2024-09-30")])]
    q = spark.createDataFrame(rows, "cik string, fiscal_year_end string, seq int, form string, reportDate string, filingDate string, primaryDocDescription string")
    assert {r["seq"]: r["quarter"] for r in filings.with_report_period(q).collect()} == {0: "Q4", 1: "Q1", 2: "Q1", 3: "Q1", 4: None, 5: "Q4"}  # October is the fourth by its month, so it is counted
    near = {r["seq"]: (r["reportDate"], r["quarter"]) for r in filings.with_related_period(filings.with_report_period(q)).collect()}
    assert near[4] == ("2025-09-30", "Q4") and near[1] == ("2025-10-31", "Q1") and filings.with_related_period(filings.with_report_period(q.limit(0))).count() == 0
    named = kept.where("form = '8-K'").withColumn("name", F.lit("x-20260502ex991.htm"))
    p = filings.attachment_period(named, "name", "filingDate").first()
    assert (p["fiscal_year"], p["quarter"], p["period_end"]) == (2027, "Q1", "2026-05-02")
    (tmp_path / "d.json").write_text(json.dumps([{"source": "s", "source_id": "1", "title": "t"}]))
    assert filings.read_disclosures(spark, str(tmp_path / "d.json")).first()["fiscal_year"] is None
    (tmp_path / "w.yaml").write_text("title_patterns: [Quarterly Results]\ncompanies:\n  - {ticker: T, name: N, cik: 12}\n")
    w = filings.watchlist(spark, str(tmp_path / "w.yaml")).first()
    assert (w["cik"], w["patterns"], w["official_domains"]) == ("0000000012", ["quarterly results"], [])


def test_transcripts(spark):
    t = [("CEO", None, "Chief", "Hello", None), (None, "Ann", "", "", "Hi "), ("X", None, None, " ", None)]
    df = spark.createDataFrame([(t,)], "t array<struct<speaker: string, name: string, title: string, content: string, text: string>>")
    assert df.select(filings.transcript_text(F.col("t")).alias("x")).first()["x"] == "CEO (Chief): Hello\n\nAnn: Hi"
    more = spark.createDataFrame([([("Ann Lee, CEO", None, "CEO", "Yes", None), (None, None, "CFO", "No", None), (None, None, None, None, "So")],)], df.schema)
    assert more.select(filings.transcript_text(F.col("t")).alias("x")).first()["x"] == "Ann Lee, CEO: Yes\n\nCFO: No\n\nSo"
    ok = lambda said, ticker="TLC", name="Talco Inc": spark.range(1).select(filings.looks_like_transcript(F.lit(said), F.lit(ticker), F.lit(name)).alias("x")).first()["x"]
    said = "Talco earnings call transcript operator " + "x" * 5000
    assert ok(said) and ok(said, "talco", "Other") and not ok(said, "ZZZ", "Umco") and not ok(said[:4000]) and not ok(said.replace("operator", "host")) and not ok(said, None, None)


def test_streams(spark, tmp_path):
    rows = [(1, "e1", "d1"), (2, "e1", "d2"), (2, "e1", "d2"), (3, None, "d3")]
    df = spark.createDataFrame(rows, "n long, event_id string, document_key string").withColumn("ts", F.timestamp_seconds(F.col("n") * 100))
    a, b = str(tmp_path / "in"), str(tmp_path / "in")
    df.coalesce(1).write.parquet(a)
    s = state.read(spark, a, df, 1)
    assert state.run_to_end(state.without_repeats(s, ["n"], "ts"), "t").count() == 3
    more = spark.createDataFrame([(9, "e1", "d9")], "n long, event_id string, document_key string").withColumn("ts", F.timestamp_seconds(F.col("n") * 100))
    more.coalesce(1).write.mode("append").parquet(b)
    got = state.run_to_end(state.follow_events(state.read(spark, a, df, 1)), "v", "update")
    assert sorted((r["version"], r["documents"], r["cause"]) for r in got.collect()) == [(1, 2, "new"), (2, 3, "late")]


def test_circuit(spark):
    at = lambda h: datetime(2026, 1, 1, h)
    rows = [("a", at(1), False, "quota"), ("a", at(2), False, "timeout"), ("b", at(1), False, "quota"), ("b", at(2), True, None), ("c", at(2), False, "timeout")]
    df = spark.createDataFrame(rows, "p string, at timestamp, ok boolean, category string")
    got = {r["p"]: r["open"] for r in state.circuit(df, "p", "at", "ok", "category", at(5)).collect()}
    assert got == {"a": True, "b": False} and not any(r["open"] for r in state.circuit(df, "p", "at", "ok", "category", at(8)).collect())
