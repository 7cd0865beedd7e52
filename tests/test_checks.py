from pyspark.sql import functions as F

from brightloom.operators import cards, checks

H = checks.HEADINGS


def lines(spark, *texts):
    return checks.lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), "k")


def sectioned(spark, *texts):
    rows = lines(spark, *texts)
    return checks.assign_sections(rows, "k", checks.heading_of(F.col("line")).isNotNull())


def test_structure(spark):
    good = "\n".join(H)
    rows = lines(spark, good, "\n".join(reversed(H)), f"{H[0]}：\n{good}", H[1], f"{good}\n📈 關鍵指標:", "no headings", None, "")
    got = {}
    for r in checks.structure_issues(rows, "k").collect():
        got.setdefault(r["k"], set()).add(r["issue"])
    assert got == {1: {"section_order"}, 2: {"section_order", "repeated_heading"}, 3: {"missing_sections"}, 4: {"older_sections"}, 5: {"missing_sections"}}
    assert checks.structure_issues(rows.limit(0), "k").count() == 0


def test_numbers_and_density(spark):
    data = f"{H[1]}\n• up 5%\n• up 6%, 因此 better\n• a | 7\n• b | 8\nno number\n外部市場共識未納入，本報告不判定 Beat/Miss。"
    s = sectioned(spark, data, f"{H[1]}\n• a | 7", None)
    assert {(r["k"], r["line_no"], r["issue"]) for r in checks.uninterpreted(s, "k", H[1]).collect()} == {(0, 2, "number_without_meaning"), (0, None, "raw_table")}
    assert {(r["k"], r["line_no"]) for r in checks.bare_lines(s, "k").collect()} == {(0, 6), (0, 7)}
    many = f"{H[0]}\n" + "• x\n" * 3 + f"{H[1]}\n" + "• y\n" * 8 + f"{H[3]}\n" + "• z\n" * 3 + f"{H[2]}\n" + "w" * 1800
    s = checks.assign_sections(lines(spark, many), "k", checks.heading_of(F.col("line")).isNotNull())
    assert {(r["section"], r["issue"], r["n"]) for r in checks.dense(s, "k").collect()} == {(H[0], "too_many_bullets", 3), (H[1], "too_many_lines", 8), (H[1], "too_many_bullets", 8), (None, "too_long", 1856)}
    assert checks.dense(s.limit(0), "k").count() == checks.uninterpreted(s.limit(0), "k", H[1]).count() == 0


def test_triangulation_and_claims(spark):
    facts = spark.createDataFrame([(0, "NRR was 120%"), (0, "RPO rose"), (0, "usage rose"), (1, "RPO"), (2, "nrr rpo usage"), (3, None)], "k int, fact string")
    s = sectioned(spark, f"{H[1]}\n• NRR 120%\n• RPO 5", f"{H[1]}\n• x", f"{H[2]}\n• nrr 120%, usage up, 顯示 demand")
    assert [(r["k"], r["concepts"]) for r in checks.untriangulated(s, facts, "k", "fact", [H[1], H[2]]).collect()] == [(0, ["backlog", "retention", "usage"])]
    said = lines(spark, "具有定價權", "尚未有資料確認定價權", "定價權仍有待驗證", "cannot confirm pricing power; it has pricing power", "瓶頸供應商", None)
    assert {(r["k"], r["category"]) for r in checks.strong_claims(said, "k").collect()} == {(0, "pricing_power"), (3, "pricing_power"), (4, "bottleneck_control")}
    backing = spark.createDataFrame([(0, "we have Pricing Power"), (3, "no"), (4, "sole source for x")], "k int, fact string")
    assert {(r["k"], r["category"]) for r in checks.unbacked_claims(said, backing, "k", "fact").collect()} == {(3, "pricing_power")}
    assert checks.strong_claims(said.limit(0), "k").count() == checks.untriangulated(s, facts.limit(0), "k", "fact", [H[1]]).count() == 0


def test_words_rates_and_consensus(spark):
    r = spark.createDataFrame([(1, "5億美元"), (2, "應為 6"), (3, "ok"), (4, None)], "k int, t string")
    assert {(x["k"], x["issue"]) for x in checks.report_issues(r, "k", "t").collect()} == {(1, "converted_currency_unit"), (2, "self_correction")}
    df = spark.createDataFrame([(1, "up 5%", "rose 5 points", 5.0), (2, "down 2.5%", "fell 2.5", -2.5), (3, "up 5%", "rose 15 or 5.5", 5.0), (4, "up 5%", None, 5.0), (5, "up 5%", "5", None), (6, None, None, None)], "k int, a string, b string, c double")
    assert sorted(x["k"] for x in checks.unbacked_rates(df, "k", "a", "b", "c").collect()) == [3, 4, 5]
    c = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "k int, m array<string>")
    assert [x["k"] for x in checks.consensus_issues(c, "k", "m").collect()] == [1]


def test_views_of_cards(spark):
    c = spark.createDataFrame([(1, "guidance", "m", "x"), (2, "qa", None, None), (3, "fact", "m", "cash_capex"), (4, "fact", "", None), (5, None, "m", None)], "card_seq int, card_type string, metric string, topic string").withColumn("g", F.lit(1))
    rows = cards.categories(c)
    assert {(r["card_seq"], r["category"]) for r in rows.collect()} == {(1, "guidance"), (2, "qa"), (3, "facts"), (3, "cash_flow_and_capex"), (5, "facts")}
    kept = cards.bounded(rows, ["g"], "category", [F.col("card_seq")], {"facts": 1, "qa": 5})
    assert {(r["card_seq"], r["category"], r["place"]) for r in kept.collect()} == {(3, "facts", 1), (2, "qa", 1), (1, "guidance", None), (3, "cash_flow_and_capex", None)}
    issues = spark.range(50).select((F.col("id") % 2).alias("k"), "id")
    assert cards.first_issues(issues, ["k"], [F.col("id")], 30).count() == 50 and cards.first_issues(issues, ["k"], [F.col("id")], 3).count() == 6


def test_empty_fingerprints_and_decoration(spark):
    rows = [(1, "T", ""), (2, "T", ""), (3, "T", "a|b"), (4, "T", "a|b")]
    df = spark.createDataFrame(rows, "card_seq int, ticker string, fp string").withColumns({"rank": F.lit(1), "mat": F.lit(1)})
    assert sorted((r["card_seq"], r["copies"]) for r in cards.dedupe(df, ["ticker"], keep=[]).collect()) == [(1, 1), (2, 1), (3, 2)]
    c = spark.createDataFrame([(7, "d#u1", " q "), (8, "none", "q"), (9, None, None)], "card_seq int, unit_id string, quote string")
    u = spark.createDataFrame([("d#u1", "d", "Third_Party_x", 3)], "unit_id string, document_key string, source string, position int")
    assert [tuple(r) for r in cards.decorated(c, u, F.col("card_seq")).select("card_id", "document_key", "provenance", "position", "quote").collect()] == [("c7:d#u1", "d", "third_party_transcript", 3, "q")]
