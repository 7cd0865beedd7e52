from datetime import date, datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.operators import articles, cards, checks, events, groups, store
from brightloom.session import table

D = "disclosure_seq long, source string, source_id string, ticker string, title string, fiscal_year int, quarter string, period_end string, metadata struct<format: string>, day string"


def docs(spark, *rows):
    return spark.createDataFrame([(i + 1, s, f"id{i}", t, title, y, q, e, (fmt,), d) for i, (s, t, title, y, q, e, fmt, d) in enumerate(rows)], D).withColumn("document_key", events.document_key())


def test_companions_and_formation(spark):
    d = docs(spark,
        ("sec_edgar", "T", "Financial results Q2 2027", 2027, "Q2", "2026-07-31", None, "d1"), ("official_ir", "T", "Slides", None, None, None, None, "d1"), ("official_ir", "T", "Q1 2026 deck", 2026, "Q1", "2025-10-31", None, "d1"),
        ("sec_edgar", "U", "Financial results Q1 2027", None, None, None, None, "d1"), ("sec_edgar", "U", "Financial results Q2 2027", None, None, None, None, "d1"), ("official_ir", "U", "Slides", None, None, None, None, "d1"),
        ("sec_edgar", None, "Financial results Q2 2027", None, None, None, None, "d1"),
    )
    got = {r["disclosure_seq"]: r for r in events.with_event(events.align_companions(events.with_period(d), "day")).collect()}
    assert got[2]["event_id"] == "T_2026-07-31_Q2" and got[2]["aligned"] and got[3]["event_id"] == "T_2025-10-31_Q1" and not got[3]["aligned"]
    assert got[6]["event_id"] is None and got[4]["event_id"] == "U_FY2027_Q1" and got[7]["event_id"] is None
    formed = {r["event_id"]: r for r in events.form_events(events.with_event(events.align_companions(events.with_period(d), "day")), "disclosure_seq").collect()}
    assert formed["T_2026-07-31_Q2"]["documents"] == 2 and formed["T_2026-07-31_Q2"]["first_key"] == "sec_edgar:id0"


def test_mirrors_and_outcomes(spark):
    d = events.with_event(events.with_period(docs(spark,
        ("official_ir", "T", "Earnings A", 2027, "Q2", None, None, "d"), ("sec_edgar", "T", "Earnings  A!", 2027, "Q2", None, None, "d"), ("official_ir", "T", "earnings a", 2027, "Q2", None, None, "d"),
        ("sec_edgar", "T", "Earnings B", 2027, "Q2", None, "ixbrl", "d"), ("official_ir", "T", "Earnings B", 2027, "Q2", None, None, "d"), ("x", None, "Earnings", 2027, "Q2", None, None, "d"), ("x", "T", "Weather", 2027, "Q2", None, None, "d"), ("x", "T", "Earnings", None, None, None, None, "d"), ("x", "T", "Earnings C", 2027, "Q2", None, None, "d"),
    )))
    assert {r[0] for r in events.suppress_mirrors(d, "disclosure_seq").select("disclosure_seq").collect()} == {1, 2, 4, 5, 6, 7, 8, 9}
    known = spark.createDataFrame([("x:id8",)], "document_key string")
    patterns = spark.createDataFrame([("T", ["quarter"])], "ticker string, patterns array<string>")
    out = {r["disclosure_seq"]: r["outcome"] for r in events.outcomes(d, known, patterns, "disclosure_seq").collect()}
    assert out == {1: "new", 2: "new", 3: "mirror", 4: "new", 5: "new", 6: "unlisted", 7: "not_results", 8: "ungroupable", 9: "seen"}


def test_nearest_and_latest(spark):
    day = lambda n: date(2026, 1, n)
    c = spark.createDataFrame([(1, "T", day(10)), (2, "T", day(20)), (3, "U", day(10)), (4, "T", None)], "seq long, ticker string, day date")
    p = spark.createDataFrame([(5, "T", day(12), "r12"), (6, "T", day(8), "r8"), (7, "T", day(8), "later"), (8, "U", day(14), "far"), (9, "T", day(10), None)], "seq long, ticker string, day date, period_end string")
    got = {r["seq"]: (r["gap_days"], r["report_date"]) for r in events.nearest_periodic(c, p, "ticker", "day", "period_end").collect()}
    assert got == {1: (2, "r12"), 2: (None, None), 3: (None, None), 4: (None, None)}
    s = spark.createDataFrame([("e", 1, None), ("e", 2, datetime(2026, 1, 1)), ("e", 3, datetime(2026, 1, 1)), ("f", 9, None)], "event_id string, n long, at timestamp")
    assert {(r["event_id"], r["n"]) for r in events.latest_state(s, "event_id", "at", "n").collect()} == {("e", 3), ("f", 9)}


def test_manifest(spark):
    m = events.manifest(spark.createDataFrame([("e", "financial_results", "sec_edgar"), ("e", "transcript", "official_ir"), ("e", None, "sec_edgar")], "event_id string, document_kind string, source string"), ["event_id"]).first()
    assert m["documents"] == 3 and m["kinds"] == {"": 1, "financial_results": 1, "transcript": 1} and m["has_primary_results"] and m["has_official_ir"] and not m["has_presentation"]


def test_positions_of_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).alias("hot"), F.when(F.col("id") % 11 == 0, None).otherwise(F.lit("k")).alias("k"), F.col("id").alias("at"))
    got = groups.numbered(df, ["hot", "k"], ["at"], parts=6).toPandas()
    want = got.sort_values("at").groupby(["hot", "k"], dropna=False).cumcount() + 1
    assert (got["position"] == want.reindex(got.index)).all() and len(got) == 3000


def test_cards(spark, sf):
    raw = cards.ranked(table(spark, sf, "cards"))
    one = cards.dedupe(raw, ["ticker"]).toPandas()
    p = raw.select("ticker", "fp", "rank", "mat", "card_seq").toPandas().fillna({"ticker": ""})
    best = p.sort_values(["rank", "mat", "card_seq"], ascending=[False, False, True]).groupby(["ticker", "fp"]).card_seq.first()
    assert set(best) == set(one.card_seq)
    many = spark.createDataFrame([(i, "T", "fact", f"topic{i % 3}" if i % 5 else "risk", str(i), 1 + (i % 3), i) for i in range(200)] + [(500, "T", "guidance", "guidance", "g", 1, 0), (501, "T", "qa", "qa_management", "q", 3, 0)],
        "card_seq long, ticker string, card_type string, topic string, statement string, materiality_candidate int, position int")
    for c in ("metric", "value_text", "unit", "period", "reported_change", "question_summary", "answer_summary", "source", "provenance", "unit_id"):
        many = many.withColumn(c, F.lit(None).cast("string"))
    many = many.withColumn("value_num", F.lit(None).cast("double"))
    chosen = cards.select(cards.dedupe(cards.ranked(many), ["ticker"]), "ticker").toPandas()
    assert len(chosen) == 90 and set(chosen[chosen.why == "mandatory"].card_seq) == {500, 501} and (chosen[chosen.why == "quota"].topic_key == "risk").sum() == 4


def test_quotes(spark):
    c = spark.createDataFrame([(1, "d", "Revenue rose\nfive percent"), (2, "d", "never said anywhere"), (3, "d", "short"), (4, "other", "never said anywhere"), (5, "d", None)], "card_seq long, document_key string, quote string")
    e = spark.createDataFrame([("d", "x REVENUE  rose five percent y"), ("d", None), (None, "z")], "document_key string, text string")
    assert [r["card_seq"] for r in cards.quotes_missing(c, e).collect()] == [2]


def test_fact_checks(spark):
    rows = [(1, 1.0, None, None, "lower_bound", "at least 1", None, None, None), (2, 1.0, None, None, "lower_bound", "about 1", None, None, None), (3, 1.0, 1.5, 2.0, None, None, None, None, None), (4, 1.0, 1.6, 2.0, None, None, None, None, None), (5, None, None, None, None, None, "Adjusted FCF", "standard_fcf", [])]
    df = spark.createDataFrame(rows, "card_seq long, low double, midpoint double, high double, guidance_type string, quote string, metric string, metric_type string, reconciliation array<string>")
    got = {(r["card_seq"], r["issue"]) for r in checks.fact_issues(df).collect()}
    assert got == {(2, "incomplete_range"), (4, "midpoint_not_range_average"), (5, "adjusted_metric_taxonomy_mismatch"), (5, "adjusted_mislabelled_standard"), (5, "adjusted_metric_missing_reconciliation")}


def test_line_checks(spark):
    t = "HEAD LINE\n　the very same line of a report is here 5%\r\n• The very same  line of a report is here 5%\nOTHER PART\nrevenue was 5 in FY2026, FY26 and FY 2026"
    rows = checks.lines(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string"), "doc_id")
    assert checks.repeated_lines(rows, ["doc_id"]).first()["times"] == 2 and checks.year_labels(rows, "doc_id").first()["times"] == 3
    s = checks.assign_sections(rows, "doc_id", F.col("line").rlike("^[A-Z ]+$"))
    assert {(r["line_no"], r["section"]) for r in s.collect()} == {(2, "HEAD LINE"), (3, "HEAD LINE"), (5, "OTHER PART")}
    both = s.unionByName(s.withColumn("section", F.lit("third"))).unionByName(s.withColumn("section", F.lit("fourth")))
    assert checks.metric_in_sections(both, "doc_id", ["revenue"]).first()["sections"] == 3
    assert checks.shared_pairs(both, "doc_id", ["revenue"], "third", "fourth").count() >= 1
    claims = spark.createDataFrame([(1, "they have pricing power"), (2, "not proven pricing power"), (3, "pricing power to be verified")], "doc_id long, line string")
    got = checks.strong_claims(claims, "doc_id", {"power": ["pricing power"]}, "not (?:proven|confirmed)", " to be verified")
    assert [r["doc_id"] for r in got.collect()] == [1]
    assert [r["rate"] for r in checks.unbacked_rates(spark.createDataFrame([(1, "up 5% and 7%", "7.0 %")], "k int, a string, b string"), "k", "a", "b").collect()] == ["5%"]


def test_articles(spark):
    rows = [(1, "https://a.x/1?utm_a=1", "One", 9), (2, "https://www.a.x/1", "Other", 8), (3, "https://a.x/2", "ONE!", 7), (4, "https://a.x/3", "", 6), (5, "https://a.x/4", None, 5), (6, "https://a.x/5", "Six", 4)]
    df = spark.createDataFrame([(*r, "T") for r in rows], "n long, url string, title string, score int, ticker string")
    order = [-F.col("score"), F.col("n")]
    got = articles.pick(df, ["ticker"], order, 3).orderBy("picked").collect()
    assert [(r["n"], r["picked"]) for r in got] == [(1, 1), (4, 2), (5, 3)]
    three = spark.createDataFrame([(1, "https://a.x/0", "one", 9, "T"), (2, "https://a.x/1", "one", 8, "T"), (3, "https://a.x/1", "two", 7, "T")], df.schema)
    assert [r["n"] for r in articles.pick(three, ["ticker"], order, 10).orderBy("picked").collect()] == [1, 3]  # what is stopped by its title doesn't stop others by its link
    assert spark.range(1).select(articles.split_blocks(F.array(F.lit("a" * 30), F.lit("b" * 30), F.lit("c")), 40).alias("x")).first()["x"] == ["a" * 30, "b" * 30 + "\n\nc"]
    score = spark.createDataFrame([("news.a.x",), ("b.y",)], "d string").select(articles.domain_score(F.col("d"), {"a.x": 5}).alias("s")).collect()
    assert [r["s"] for r in score] == [5, 50]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=25), min_size=1, max_size=6))
def test_picks_are_those_of_a_walk(spark, groups):
    rows = [(g, n, f"https://a.x/{link}", ["", "one", "two", "three", "four"][title]) for g, arts in enumerate(groups) for n, (link, title) in enumerate(arts)]
    want = set()
    for g, arts in enumerate(groups):
        links, titles, k = set(), {0}, 0
        for n, (link, title) in enumerate(arts):
            if k < 2 and link not in links and (title == 0 or title not in titles):
                links.add(link), titles.add(title)
                k += 1
                want.add((g, n, k))
    df = spark.createDataFrame(rows, "g int, n int, url string, title string")
    assert {(r["g"], r["n"], r["picked"]) for r in articles.pick(df, ["g"], [F.col("n")], 2).collect()} == want


def test_found_and_validated_articles(spark):
    now = datetime(2026, 1, 2)
    rows = [(1, "HTTPS://www.A.x/1/?utm_b=2", "One", datetime(2026, 1, 1, 9)), (2, "https://a.x/1", "Two", datetime(2026, 1, 1, 8)), (3, "http://a.x/3", "Three", now), (4, "https://a.x/4", " ", now), (5, "https://a.x/5", "Old", datetime(2025, 12, 31)), (6, "https://news.ft.com/6", "Six", now), (7, None, "x", now)]
    df = spark.createDataFrame(rows, "n int, url string, title string, at timestamp")
    got = articles.discovered(df, "url", "title", "at", F.lit(now), [F.col("n")])
    assert {(r["n"], r["link"], r["domain"]) for r in got.collect()} == {(1, "https://a.x/1", "a.x"), (6, "https://news.ft.com/6", "news.ft.com")}
    known = got.select("link", F.col("at").alias("effective_at"), articles.source_name(F.col("domain")).alias("source_name"))
    items = spark.createDataFrame([("g", 1, "https://a.x/1?ref=z", "h", "f", "s"), ("g", 2, "https://news.ft.com/6", "h", "f", "s" * 301), ("g", 3, "https://news.ft.com/6", "h", "", "s"), ("g", 4, "https://news.ft.com/6", "h", "f", "s"), ("g", 5, "https://zz.x/1", "h", "f", "s")], "g string, n int, url string, headline string, fact string, summary string")
    out = articles.validated(items, known, F.lit(now), [F.col("n")], ["g"], 2).orderBy("n").collect()
    assert [(r["n"], r["source_name"], r["item"]) for r in out] == [(1, "a.x", 1), (4, "Financial Times", 2)]
    assert articles.validated(items.limit(0), known, F.lit(now), [F.col("n")], ["g"], 2).count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.read("t") is None
    s.merge("t", spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int"), ["k"], [-F.col("at")])
    s.merge("t", spark.createDataFrame([(2, "c", 2), (3, "d", 0)], "k int, v string, at int"), ["k"], [-F.col("at")])
    assert {(r["k"], r["v"]) for r in s.read("t").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_fingerprints_and_stages(spark):
    rows = [("g", "d1", "t", "u", "x", None, None), ("g", "d2", "t", "u", "y", None, None)]
    schema = "g string, document_key string, title string, url string, text string, structured_facts array<struct<a: string>>, metadata struct<b: string>"
    f = lambda r: store.fingerprint(spark.createDataFrame(r, schema), ["g"]).first()["fingerprint"]
    assert f(rows) == f(rows[::-1]) != f([rows[0], (*rows[1][:4], "z", None, None)])
    want = spark.createDataFrame([("e", "f1", "a"), ("e", "f1", "b")], "key string, fingerprint string, stage string")
    done = spark.createDataFrame([("e", "f1", "a", 2), ("e", "f0", "b", 2)], "key string, fingerprint string, stage string, pipeline_version int")
    assert [r["stage"] for r in store.stages_to_run(want, done, 2).collect()] == ["b"] and store.stages_to_run(want, done, 3).count() == 2
    parts = spark.createDataFrame([("k", 2, "", ["b", "a"]), ("k", 1, None, ["a"]), ("k", 3, "s", None)], "k string, n int, s string, l array<string>")
    assert tuple(store.merge_parts(parts, "k", "n", ["l"], ["s"]).first()) == ("k", "s", ["a", "b"])
