from datetime import date

import pytest
from pyspark.sql import functions as F

from brightloom.operators import pages
from brightloom.sources import markup

COMPANY = "ticker string, ir_index_url string, ir_additional_urls array<string>, official_domains array<string>"
EVENT = "event_id string, ticker string, fiscal_year int, quarter string, period_end string"
INDEX = """<h1>Results</h1><ul><li><a href="/q2">Second quarter 2026 earnings</a></li><li><a href="/q2">Q2 2026 earnings again</a></li><li><a href="https://cdn.other.example/a.pdf">Q2 2026 presentation</a></li>
<li><a href="/events/day">Q2 2026 webcast</a></li><li><a href="/jobs">Jobs</a></li><li><a href="deck.pdf">Q2 2026 presentation</a></li><li><a href="lost.html">Q2 2026 results, quarterly</a></li></ul><script>{"f": "\\/files\\/q2-2026-transcript.txt", "g": "/deck.pdf"}</script>"""
CHILD = "<h1>Q2 2026 results</h1><p><a href='tables.xlsx'>Supplement</a></p><p><a href='/deck.pdf'>presentation</a></p>"


@pytest.mark.parametrize("target,context,document,page", [
    ("https://a.x/deck.pdf", "", True, False), ("https://a.x/events/1", "webcast results", False, True), ("https://a.x/events/1.html", "x", True, False), ("https://a.x/q2", "Earnings webcast", True, True), ("https://a.x/q2.aspx", "fiscal year", False, True),
    ("https://a.x/q2.xlsx?v=1", "quarter", True, False), ("https://a.x/", "", False, False), (None, None, False, False),
])
def test_kinds_of_links(spark, target, context, document, page):
    df = spark.createDataFrame([(target, context)], "t string, c string")
    got = df.select(pages.looks_like_document(F.col("t"), F.col("c")).alias("d"), pages.looks_like_event_page(F.col("t"), F.col("c")).alias("p")).first()
    assert (bool(got["d"]), bool(got["p"])) == (document, page)


def test_documents_of_pages(spark):
    p = spark.createDataFrame([(1, "T", date(2026, 7, 1), "https://ir.a.example/", INDEX), (2, "T", date(2026, 7, 1), "https://ir.a.example/q2", CHILD), (3, "U", date(2026, 7, 1), "https://u.example/", INDEX), (4, "T", None, None, None)], "page_id int, ticker string, day date, url string, html string")
    companies = spark.createDataFrame([("T", "https://ir.a.example/", None, ["a.example", ""]), ("U", None, [], None)], COMPANY)
    events = spark.createDataFrame([("T_Q2", "T", 2026, "Q2", None), ("T_Q1", "T", 2026, "Q1", None)], EVENT)
    links = markup.links(p).join(p.select("page_id", "ticker", "day"), "page_id")
    found = pages.page_documents(links, companies, events)
    got = {(r["page_id"], r["target"]): r for r in found.collect()}
    assert set(got) == {(1, "https://ir.a.example/q2"), (1, "https://ir.a.example/events/day"), (1, "https://ir.a.example/deck.pdf"), (1, "https://ir.a.example/lost.html"), (1, "https://ir.a.example/files/q2-2026-transcript.txt"), (2, "https://ir.a.example/tables.xlsx"), (2, "https://ir.a.example/deck.pdf")}
    first = got[(1, "https://ir.a.example/q2")]
    assert first["title"] == "Second quarter 2026 earnings" and first["event_id"] == "T_Q2" and first["format"] == "unknown" and first["is_event_page"] and len(first["source_id"]) == 24
    assert not got[(1, "https://ir.a.example/events/day")]["is_document"] and got[(1, "https://ir.a.example/files/q2-2026-transcript.txt")]["is_document"] and got[(2, "https://ir.a.example/tables.xlsx")]["event_id"] == "T_Q2"
    walked = {(r["hop"], r["target"].rsplit("/", 1)[1], r["missing"]) for r in pages.crawled(found, p, p.where("page_id = 1")).collect()}
    assert {(0, "q2", False), (0, "deck.pdf", False), (1, "tables.xlsx", False)} <= walked and any(m and t == "lost.html" for _, t, m in walked) and (1, "deck.pdf", False) not in walked
    assert pages.page_documents(links.limit(0), companies, events).count() == pages.page_documents(links, companies.limit(0), events).count() == 0
    assert pages.crawled(found, p, p.limit(0)).count() == 0
