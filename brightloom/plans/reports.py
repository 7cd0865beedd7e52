"""Queries of the checks of reports, and the SQL that says the same.

Reports are made of cards: one a document, with a section for topics that belong together, a line a card, and headings that some reports lack, repeat or write otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text
from brightloom.operators import articles, checks, evidence, extraction, unitize
from brightloom.plans.documents import _LATEST, _PARTS, _SENTENCES, _SIGNALS, _UNITS, _WS, _squeeze, evidence_units, placed
from brightloom.session import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_H = ["💡 投資結論與邏輯", "📊 關鍵數據與財測", "🧭 營運動能與法說攻防", "⚠️ 風險、反證與待驗證"]
_HEADS = ", ".join(f"'{h}'" for h in _H)
_TOPICS = [["demand_revenue", "guidance"], ["margin_unit_economics", "cash_capex", "customer_usage"], ["product_competition", "supply_capacity", "qa_management"]]


def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, line_no, section, line) of cards, line_no odd."""
    c = table(spark, sf_dir, "cards").where("statement IS NOT NULL AND document_key IS NOT NULL")
    section = F.lit(_H[3])
    for h, topics in reversed(list(zip(_H, _TOPICS))):
        section = F.when(F.col("topic").isin(topics), h).otherwise(section)
    said = F.concat(F.regexp_replace("statement", r"(?U)^\s+|\s+$", ""), F.coalesce(F.concat(F.lit(" ("), "period", F.lit(")")), F.lit("")))
    line = F.concat(F.when(F.col("card_seq") % 13 == 0, F.lit("- ")).otherwise(F.lit("• ")), said, F.when(F.col("card_seq") % 4 == 0, F.lit(" | table")).otherwise(F.lit("")), F.when(F.col("card_seq") % 50 == 0, F.lit(" 約5億美元")).otherwise(F.lit("")), F.when(F.col("card_seq") % 60 == 0, F.lit(" 更正為6")).otherwise(F.lit("")))
    return c.select(F.col("document_key").alias("report"), (F.col("card_seq") * 2 + 1).alias("line_no"), section.alias("section"), line.alias("line"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, line_no, line) with headings, line_no even: of each section before its first line, of some again before their last, and of some an older one."""
    lines = card_lines(spark, sf_dir)
    ends = lines.groupBy("report", "section").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    named = F.when(F.col("a") % 3 == 0, F.concat(F.lit("  "), "section", F.lit(" ："))).otherwise(F.col("section"))
    rows = F.array(F.struct((F.col("a") - 1).alias("line_no"), named.alias("line")), F.when((F.col("a") < F.col("b")) & (F.col("a") % 5 == 0), F.struct((F.col("b") - 1).alias("line_no"), F.col("section").alias("line"))), F.when(F.col("a") % 7 == 0, F.struct((F.col("a") - 1).alias("line_no"), F.lit("📈 關鍵指標:").alias("line"))))
    return lines.select("report", "line_no", "line").unionByName(ends.select("report", F.explode(F.array_compact(rows)).alias("r")).select("report", "r.line_no", "r.line"))


_REPORT = rf"""
report AS (
  SELECT document_key AS report, card_seq * 2 + 1 AS line_no, CASE WHEN topic IN ('demand_revenue', 'guidance') THEN '{_H[0]}' WHEN topic IN ('margin_unit_economics', 'cash_capex', 'customer_usage') THEN '{_H[1]}' WHEN topic IN ('product_competition', 'supply_capacity', 'qa_management') THEN '{_H[2]}' ELSE '{_H[3]}' END AS section,
    CASE WHEN card_seq % 13 = 0 THEN '- ' ELSE '• ' END || regexp_replace(statement, '^{_WS}+|{_WS}+$', '', 'g') || coalesce(' (' || period || ')', '') || CASE WHEN card_seq % 4 = 0 THEN ' | table' ELSE '' END || CASE WHEN card_seq % 50 = 0 THEN ' 約5億美元' ELSE '' END || CASE WHEN card_seq % 60 = 0 THEN ' 更正為6' ELSE '' END AS line
  FROM cards WHERE statement IS NOT NULL AND document_key IS NOT NULL),
ends AS (SELECT report, section, min(line_no) AS a, max(line_no) AS b FROM report GROUP BY ALL)"""


@query(f"""
WITH {_REPORT}, heads AS (SELECT report, section AS h, a - 1 AS n FROM ends UNION ALL SELECT report, section, b - 1 FROM ends WHERE a < b AND a % 5 = 0),
r AS (SELECT report, list(h ORDER BY n, h) AS found FROM heads GROUP BY 1), o AS (SELECT DISTINCT report FROM ends WHERE a % 7 = 0)
SELECT report, 'missing_sections' AS issue FROM r WHERE NOT list_has_all(found, [{_HEADS}]) UNION ALL SELECT report, 'section_order' FROM r WHERE found <> list_filter([{_HEADS}], lambda h: list_contains(found, h))
UNION ALL SELECT report, 'repeated_heading' FROM r WHERE len(found) <> len(list_distinct(found)) UNION ALL SELECT report, 'older_sections' FROM o""")
def report_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that lack sections, have them in another order or twice, or hold older ones."""
    return checks.structure_issues(report_lines(spark, sf_dir), "report")


@query(f"WITH {_REPORT} SELECT report, line_no, 'no_bullet' AS issue FROM report WHERE NOT starts_with(line, '• ')")
def report_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sections that don't begin with a bullet."""
    return checks.bare_lines(card_lines(spark, sf_dir), "report")


@query(f"""
WITH {_REPORT}, d AS (SELECT *, {_squeeze("line")} AS l FROM report WHERE section = '{_H[1]}' AND regexp_matches(line, '(^|[^A-Za-z])\\d'))
SELECT report, line_no, 'number_without_meaning' AS issue FROM d WHERE NOT contains(line, '|') AND NOT contains(l, 'driven by') AND NOT contains(l, 'mostly on')
UNION ALL SELECT report, NULL, 'raw_table' FROM d WHERE contains(line, '|') GROUP BY report HAVING count(*) >= 2""")
def report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of reports that nothing is said about, and tables that aren't read."""
    return checks.uninterpreted(card_lines(spark, sf_dir), "report", _H[1], ["driven by", "mostly on"])


_CONCEPTS = {"backlog": ["backlog", "orders"], "price": ["price", "pricing"], "volume": ["units shipped", "volume"], "mix": ["mix"], "restocking": ["restocking"], "yield": ["yield"]}
_NAMED = "list_filter([CASE WHEN contains(l, 'backlog') OR contains(l, 'orders') THEN 'backlog' END, CASE WHEN contains(l, 'price') OR contains(l, 'pricing') THEN 'price' END, CASE WHEN contains(l, 'units shipped') OR contains(l, 'volume') THEN 'volume' END, CASE WHEN contains(l, 'mix') THEN 'mix' END, CASE WHEN contains(l, 'restocking') THEN 'restocking' END, CASE WHEN contains(l, 'yield') THEN 'yield' END], lambda x: x IS NOT NULL)"


@query(f"""
WITH {_REPORT}, f AS (SELECT document_key AS report, {_squeeze("statement")} AS l FROM cards WHERE document_key IS NOT NULL AND statement IS NOT NULL),
k AS (SELECT report, list_sort(list(DISTINCT c)) AS c FROM (SELECT report, unnest({_NAMED}) AS c FROM f) GROUP BY 1 HAVING count(DISTINCT c) >= 3),
good AS (SELECT DISTINCT report FROM (SELECT report, {_squeeze("line")} AS l FROM report WHERE section IN ('{_H[1]}', '{_H[2]}')) WHERE len({_NAMED}) >= 2 AND contains(l, 'driven by'))
SELECT report, array_to_string(c, ',') AS concepts FROM k WHERE report NOT IN (SELECT report FROM good)""")
def report_triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose facts name three concepts or more, but of which no line brings two together."""
    facts = table(spark, sf_dir, "cards").where("document_key IS NOT NULL AND statement IS NOT NULL").select(F.col("document_key").alias("report"), "statement")
    got = checks.untriangulated(card_lines(spark, sf_dir), facts, "report", "statement", [_H[1], _H[2]], _CONCEPTS, ["driven by"])
    return got.withColumn("concepts", F.array_join("concepts", ","))


@query(f"""
WITH {_REPORT}, s AS (SELECT report, section, count(*) AS lines, count(*) FILTER (WHERE starts_with(line, '•')) AS bullets FROM report GROUP BY ALL)
SELECT report, section, 'too_many_lines' AS issue, lines AS n FROM s WHERE section = '{_H[1]}' AND lines > 7
UNION ALL SELECT report, section, 'too_many_bullets', bullets FROM s WHERE bullets > CASE section WHEN '{_H[0]}' THEN 2 WHEN '{_H[1]}' THEN 5 WHEN '{_H[3]}' THEN 3 ELSE 1000000 END
UNION ALL SELECT report, NULL, 'too_long', sum(length(line) + 1)::BIGINT - 1 FROM report GROUP BY report HAVING sum(length(line) + 1) - 1 > 1800""")
def report_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that are too long, and sections with too many lines or bullets."""
    return checks.dense(card_lines(spark, sf_dir), "report")


@query(f"""
WITH {_REPORT} SELECT line_no, 'converted_currency_unit' AS issue FROM report WHERE contains(line, '億美元') OR contains(line, '兆美元') OR contains(line, '億美金') OR contains(line, '兆美金')
UNION ALL SELECT line_no, 'self_correction' FROM report WHERE contains(line, '應為') OR contains(line, '更正為')""")
def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with converted currency units, or that correct themselves."""
    return checks.report_issues(card_lines(spark, sf_dir), "line_no", "line")


@query(f"""
WITH {_REPORT}, y AS (SELECT report, unnest(regexp_extract_all(line, '(?i)\\bFY\\s*(20)?(\\d{{2}})\\b', 2)) AS yy FROM report r JOIN (SELECT report AS k, min(line_no) AS first FROM report GROUP BY 1) f ON f.k = r.report AND r.line_no > f.first)
SELECT report, '20' || yy AS year, count(*) AS times FROM y GROUP BY ALL HAVING count(*) > 2""")
def repeated_year_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal-year labels that a report repeats."""
    return checks.year_labels(card_lines(spark, sf_dir), "report")


_METRICS = "['product revenue', '產品營收', 'revenue', '總營收', '營收', 'sales', '売上', 'operating margin', '營業利益率', '營業利潤率', '営業利益率', 'gross margin', '毛利率', 'rpo', 'backlog', '受注残', 'orders', '受注', 'eps', 'fcf', 'free cash flow', 'capex', '設備投資', 'guidance', '指引', '業績予想', 'nrr', 'net revenue retention']"
_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(line, '([-+]?\$|[-+])', ' \1', 'g'), '(?i)(?:^|[^A-Za-z])([-+]?\$?\d[\d,.]*(?:\s?(?:%|bps?|bp|million|billion|trillion|m|b|bn|億|兆|萬|万))?)', 1), lambda x: regexp_replace(lower(trim(x, ' ')), '\s+', ' ', 'g'))))"


@query(f"""
WITH r AS (SELECT ticker, coalesce(fact_class, 'header') AS section, statement AS line, {_squeeze("statement")} AS l FROM cards WHERE statement IS NOT NULL),
m AS (SELECT ticker, section, list_filter({_METRICS}, lambda m: contains(l, m))[1] AS metric, array_to_string({_NUMBERS}[1:4], '/') AS numbers FROM r)
SELECT ticker, metric, numbers, count(DISTINCT section) AS sections FROM m WHERE metric IS NOT NULL AND numbers <> '' GROUP BY ALL HAVING count(DISTINCT section) >= 3""")
def repeated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics told with the same numbers in three sections of a company's cards or more; sections are classes of facts."""
    rows = table(spark, sf_dir, "cards").where("statement IS NOT NULL").select("ticker", F.col("fact_class").alias("section"), F.col("statement").alias("line"))
    return checks.metric_in_sections(rows, "ticker")


@query(f"""
WITH r AS (SELECT ticker, fact_class AS section, statement AS line, {_squeeze("statement")} AS l FROM cards WHERE statement IS NOT NULL AND fact_class IN ('objective_fact', 'management_claim')),
p AS (SELECT ticker, section, metric, unnest({_NUMBERS}) AS number FROM (SELECT *, unnest(list_filter({_METRICS}, lambda m: contains(l, m))[1:2]) AS metric FROM r))
SELECT ticker, metric, number FROM p WHERE section = 'objective_fact' INTERSECT SELECT ticker, metric, number FROM p WHERE section = 'management_claim'""")
def shared_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a metric and a number that a company's facts and claims share."""
    rows = table(spark, sf_dir, "cards").where("statement IS NOT NULL").select("ticker", F.col("fact_class").alias("section"), F.col("statement").alias("line"))
    return checks.shared_pairs(rows, "ticker", None, "objective_fact", "management_claim")


_CLAIM = {"ramp": "ramps|ramp", "restocking": "channel restocking"}
_SAID = " UNION ALL ".join(
    f"SELECT report, '{c}' AS category FROM clauses WHERE regexp_matches(regexp_replace(clause, '(?:not (?:established|proven|on)).{{0,32}}?(?:{w})|(?:{w})(?: of| is)', '', 'g'), '{w}')" for c, w in _CLAIM.items()
)


@query(f"""
WITH {_REPORT}, clauses AS (SELECT report, unnest(string_split_regex({_squeeze("line")}, '[。；;，,]')) AS clause FROM report), said AS (SELECT DISTINCT * FROM ({_SAID})),
f AS (SELECT document_key AS report, {_squeeze("quote")} AS l FROM cards WHERE document_key IS NOT NULL AND statement IS NOT NULL),
backed AS (SELECT DISTINCT report, category FROM (SELECT report, CASE WHEN contains(l, 'new program ramps') THEN 'ramp' END AS category FROM f UNION ALL SELECT report, CASE WHEN contains(l, 'channel restocking') THEN 'restocking' END FROM f))
SELECT s.report, s.category FROM said s ANTI JOIN backed b ON b.report = s.report AND b.category = s.category""")
def unbacked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of reports that no quote of their document backs."""
    facts = table(spark, sf_dir, "cards").where("document_key IS NOT NULL AND statement IS NOT NULL").select(F.col("document_key").alias("report"), "quote")
    claims, backs = {"ramp": ["ramps", "ramp"], "restocking": ["channel restocking"]}, {"ramp": ["new program ramps"], "restocking": ["channel restocking"]}
    return checks.unbacked_claims(card_lines(spark, sf_dir), facts, "report", "quote", claims, backs, r"not (?:established|proven|on)", " of| is")


@query(rf"""
WITH raw AS (SELECT card_seq, '[M' || (1 + card_seq % 5) || '｜B] [ driver ] intro' || chr(10) || '  • Claim : ' || coalesce(metric, '') || ' | Evidence : ' || coalesce(unit, '') || chr(10) || ' └ weak link: ' || coalesce(period, '') || chr(10) || chr(10) || '🏢 業務部門 / 客戶ROI：x' || chr(10) || chr(10) || '🎙️ 法說 q&a : ' || coalesce(topic, '') || chr(10)
    || CASE WHEN card_seq % 2 = 0 THEN chr(10) || '⚖️ end' ELSE 'end' END AS t FROM cards),
clean AS (SELECT card_seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\[(?:\s*M[1-5]\s*[|｜]\s*[ABCD]\s*|\s*(?:Driver|Lever|Catalyst|Risk|Missing|Alternative)\s*)\]\s*', '', 'g'), '(?im)^\s*└\s*Weak link\s*:\s*', '└ 尚未確認: ', 'g'), '(?im)^\s*•\s*Claim\s*:\s*', '• ', 'g'), '\s*\|\s*Evidence\s*:\s*', '；證據：', 'g') AS t FROM raw)
SELECT card_seq, replace(t, '🏢 業務部門 / 客戶ROI：', '🏢 業務部門:' || chr(10) || '└ 客戶/ROI:') AS report, regexp_replace(replace(t, '🏢 業務部門 / 客戶ROI：', '🏢 業務部門:' || chr(10) || '└ 客戶/ROI:'), '(?is)\n{{2,}}🎙️\s*法說\s*Q&A\s*[:：].*?(\n{{2,}}⚖️|\z)', '\1') AS short FROM clean""")
def clean_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without an analyst's own labels and with the headers of today; and without their section on a call."""
    n = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat(
        F.lit("[M"), F.col("card_seq") % 5 + 1, F.lit("｜B] [ driver ] intro\n  • Claim : "), n("metric"), F.lit(" | Evidence : "), n("unit"), F.lit("\n └ weak link: "), n("period"), F.lit("\n\n🏢 業務部門 / 客戶ROI：x\n\n🎙️ 法說 q&a : "), n("topic"), F.lit("\n"),
        F.when(F.col("card_seq") % 2 == 0, F.lit("\n⚖️ end")).otherwise(F.lit("end")),
    )
    clean = evidence.report_headers(raw)
    return table(spark, sf_dir, "cards").select("card_seq", clean.alias("report"), evidence.without_call_section(clean).alias("short"))


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(rf"""
WITH {_LATEST}, s AS (SELECT event_id, regexp_replace(title, '\s*\[XBRL\]$', '') AS shown, url, min(disclosure_seq) AS n FROM placed WHERE event_id IS NOT NULL AND coalesce(metadata.format, '') <> 'ixbrl' GROUP BY ALL),
l AS (SELECT event_id, string_agg('• <a href="' || {_escaped("coalesce(url, '')")} || '">' || {_escaped("coalesce(shown, '')")} || '</a>', chr(10) ORDER BY n) AS below FROM s GROUP BY 1),
m AS (SELECT e.event_id, 'Report on ' || e.event_id || ' 😀' || chr(10) || chr(10) || '資料來源:' || chr(10) || coalesce(below, '') AS message FROM (SELECT DISTINCT event_id FROM placed WHERE event_id IS NOT NULL) e LEFT JOIN l ON l.event_id = e.event_id)
SELECT event_id, md5(message) AS digest, (length(message) + 1)::INT AS units, length(message) + 1 <= 4000 AS fits FROM m""")
def composed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of events with their sources below, and whether a message holds them."""
    p = placed(spark, sf_dir).where("event_id IS NOT NULL")
    bodies = p.select("event_id").distinct().withColumn("body", F.concat(F.lit(" Report on "), "event_id", F.lit(" 😀 ")))
    return evidence.composed(bodies, p, "event_id", "body", [F.col("disclosure_seq")]).select("event_id", F.md5("message").alias("digest"), "units", "fits")


@query(rf"""
WITH r AS (SELECT card_seq, 'It is <b> & so' || chr(10) || CASE WHEN card_seq % 3 <> 0 THEN '📈 關鍵指標:' || chr(10) ELSE '' END AS a, '  ' || coalesce(metric, '') || ' | ' || coalesce(unit, '') || ' <' || chr(10) AS b, CASE WHEN card_seq % 5 <> 0 THEN chr(10) || chr(10) || '🏢 業務部門:' ELSE '' END || ' "end"' AS c FROM cards)
SELECT card_seq, CASE WHEN card_seq % 3 <> 0 AND card_seq % 5 <> 0 THEN 'It is &lt;b&gt; &amp; so' || chr(10) || '📈 關鍵指標:' || chr(10) || '<pre>' || {_escaped(f"regexp_replace(b, '^{_WS}+|{_WS}+$', '', 'g')")} || '</pre>' || chr(10) || chr(10) || '🏢 業務部門: &quot;end&quot;' ELSE {_escaped("a || b || c")} END AS report FROM r""")
def marked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports for markup, whose table keeps its columns."""
    n, empty = F.col("card_seq"), F.lit("")
    said = F.concat(
        F.lit("It is <b> & so\n"), F.when(n % 3 != 0, F.lit("📈 關鍵指標:\n")).otherwise(empty), F.lit("  "), F.coalesce("metric", empty), F.lit(" | "), F.coalesce("unit", empty), F.lit(" <\n"),
        F.when(n % 5 != 0, F.lit("\n\n🏢 業務部門:")).otherwise(empty), F.lit(' "end"'),
    )
    return table(spark, sf_dir, "cards").select("card_seq", evidence.report_markup(said).alias("report"))


@query(f"""
WITH RECURSIVE p AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, {_PARTS} AS parts FROM documents)),
f AS (SELECT doc_id, i, length(t)::BIGINT AS size, 1 AS m FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN f.size + 7 + length(p.t) > 3900 THEN length(p.t) ELSE f.size + 7 + length(p.t) END, f.m + (f.size + 7 + length(p.t) > 3900)::INT FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
SELECT p.doc_id, f.m AS message, md5(string_agg(p.t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.i)) AS digest, (sum(length(p.t) + 7) - 7)::INT AS chars FROM p JOIN f ON f.doc_id = p.doc_id AND f.i = p.i GROUP BY ALL""")
def split_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in messages of at most 3,900 characters; no paragraph is split."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("p"))
    m = d.select("doc_id", F.posexplode(articles.split_blocks(F.col("p"), 3900, "\n\n---\n\n")).alias("at", "m"))
    return m.select("doc_id", (F.col("at") + 1).alias("message"), F.md5("m").alias("digest"), F.length("m").alias("chars"))


@query(f"""
WITH RECURSIVE {_UNITS}, s AS (SELECT unit_id, document_key, unnest({_SENTENCES.replace("regexp_replace(c,", "regexp_replace(unit,")}) AS said FROM named_units),
c AS (SELECT document_key, said, list_filter([{", ".join(f"'{w}'" for w in _SIGNALS)}], lambda w: contains(lower(said), w))[1] AS metric FROM s WHERE regexp_matches(said, '[0-9]'))
SELECT document_key, metric, CASE WHEN metric IN ('guidance', 'outlook') THEN 'guidance' ELSE 'fact' END AS card_type, count(*) AS cards, count(*) AS backed, md5(string_agg(said, '|' ORDER BY said)) AS digest FROM c WHERE metric IS NOT NULL GROUP BY ALL""")
def extracted_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that the client by rules finds in units, by document and metric."""
    u = stored(evidence_units(spark, sf_dir).where("position > 0"), "units")
    e = table(spark, sf_dir, "evidence").select("evidence_id", "document_key")
    units = u.join(e, "evidence_id").select("document_key", F.concat_ws("@", "unit_id", "evidence_id").alias("unit_id"), "unit")  # a document fetched twice has units of one name
    batch = unitize.batches(u).select("evidence_id", F.concat_ws("@", "unit_id", "evidence_id").alias("unit_id"), "position", "batch")
    cards, _ = extraction.extract_cards(units, batch, extraction.RuleClient())
    said = F.md5(F.array_join(F.array_sort(F.collect_list("statement")), "|"))  # of one metric in one document
    return cards.groupBy("document_key", "metric", "card_type").agg(F.count(F.lit(1)).alias("cards"), F.count_if("backed").alias("backed"), said.alias("digest"))
