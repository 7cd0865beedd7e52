"""Queries over disclosures, events, evidence, cards and documents, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import periods, text, urls
from brightloom.operators import articles, cards, checks, events, evidence, store, unitize
from brightloom.operators.groups import numbered
from brightloom.session import spread, stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def count() -> Column:
    return F.count(F.lit(1))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WS = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EDGE = r"[^\p{L}\p{N}_]"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# What the SQL below is written with is spelled out here and not taken from the modules that it checks.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))  # full-width forms, in the order of ASCII
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_KIND = """CASE WHEN contains(lower(title), 'q&a') OR contains(title, '質疑') THEN 'qa' WHEN contains(lower(title), 'transcript') OR contains(title, '逐語') THEN 'transcript'
  WHEN contains(lower(title), 'prepared remarks') THEN 'prepared_remarks' WHEN contains(lower(title), 'financial tables') THEN 'financial_tables' WHEN contains(lower(title), 'performance review') THEN 'performance_review'
  WHEN contains(title, '説明会') OR contains(lower(title), 'presentation') THEN 'presentation' WHEN contains(title, '補足') OR contains(lower(title), 'supplement') THEN 'supplement'
  WHEN contains(title, '決算') OR contains(lower(title), 'financial results') OR contains(lower(title), 'earnings') OR contains(lower(title), 'press release') THEN 'financial_results' WHEN title IS NOT NULL THEN 'other' END"""
_SIGNALS = ("revenue,guidance,outlook,margin,gross margin,operating margin,free cash flow,cash flow,capex,capital expenditure,customer,customers,demand,orders,backlog,supply,capacity,utilization,"
    "shipment,shipments,pricing,price,competition,competitive,market share,ai,xpu,accelerator,networking,inference,model,usage,consumption,adoption,roi,productivity").split(",")  # fmt: skip
_QA = ["question-and-answer session", "question and answer session", "questions and answers", "q&a session", "we will now begin the question-and-answer", "we'll now begin the question-and-answer", "we will now take questions", "we'll now take questions"]
_CALL = ["transcript", "earnings call", "conference call", "prepared remarks", "question-and-answer", "q&a"]
_MIRRORS = "('official_ir', 'gemini_grounded_ir', 'openai_web_ir')"
_RESULTS = ["form 10-q", "form 10-k", "financial results", "earnings results", "earnings release", "quarterly results"]


def _fold(c: str) -> str:
    """NFKC and case folding of the characters that the tables hold: blanks, a hyphen, superscripts, numbers in circles, ligatures, full-width forms and sharp s."""
    plain = f"translate({c}, '\u00a0\u2009\u202f\u3000\u2011²①{_WIDE}', '    \u201021{_PLAIN}')"
    return f"replace(replace(lower(nfc_normalize({plain})), 'ß', 'ss'), 'ﬁ', 'fi')"


_TITLE_KEY = rf"regexp_replace(replace({_fold('title')}, '[xbrl]', ''), '[^0-9a-z一-龥ぁ-んァ-ヶ]+', '', 'g')"


@query(f"SELECT disclosure_seq, {_KIND} AS kind FROM disclosures")
def title_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "disclosures").select("disclosure_seq", text.classify_title(F.col("title")).alias("kind"))


@query(f"SELECT {_TITLE_KEY} AS title_key, count(*) AS titles FROM disclosures GROUP BY 1")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "disclosures").groupBy(text.title_key(F.col("title")).alias("title_key")).agg(count().alias("titles"))


_TERM_HITS = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in _SIGNALS)


@query(rf"""
SELECT doc_id, round((({_TERM_HITS}) * 4 + least(len(regexp_extract_all(text, '(?:^|{_EDGE})\d[\d,]*(?:\.\d+)?%?')), 40) * 0.6
  + len(regexp_extract_all(regexp_replace(lower(text), '({_EDGE})', '\1\1', 'g'), '(?:^|{_EDGE})(?:q[1-4]|fy(?:\s\s)?20\d{{2}}|20\d{{2}})(?:$|{_EDGE})')) * 0.5)::DOUBLE, 4) AS score
FROM documents WHERE text IS NOT NULL""")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.round(text.page_score(F.col("text")), 4).alias("score"))


@query("SELECT doc_id, sha256(text) AS digest, left(sha256(text), 24) AS short_digest FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("digest"), F.substring(d, 1, 24).alias("short_digest"))


_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_HOST = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_KEPT = r"array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?i)(utm_[^=]*|ref|source|ocid|output)(=|$)')), '&')"
_ARTICLE = rf"{_SCHEME} || '://' || regexp_replace({_HOST}, '^www\.', '') || coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"


@query(f"""
SELECT disclosure_seq, {_ARTICLE} AS link, {_HOST} AS host FROM (
  SELECT disclosure_seq, CASE disclosure_seq % 4 WHEN 0 THEN url WHEN 1 THEN upper(left(url, 8)) || 'WWW.' || substr(url, 9) || '/?utm_source=feed&id=' || disclosure_seq || '&ref=a#top' WHEN 2 THEN url || '//?source&page=2&&OCID=x' ELSE url || '#part?a=b' END AS url
  FROM disclosures WHERE url IS NOT NULL)""")
def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form for links of one article, also where they carry trackers, fragments and other spellings of the host."""
    u, seq = F.col("url"), F.col("disclosure_seq")
    dirty = F.when(seq % 4 == 0, u).when(seq % 4 == 1, F.concat(F.upper(F.substring(u, 1, 8)), F.lit("WWW."), F.substring(u, 9, 10**6), F.lit("/?utm_source=feed&id="), seq, F.lit("&ref=a#top"))).when(seq % 4 == 2, F.concat(u, F.lit("//?source&page=2&&OCID=x"))).otherwise(F.concat(u, F.lit("#part?a=b")))
    d = table(spark, sf_dir, "disclosures").where(u.isNotNull()).select(seq, dirty.alias("url"))
    return d.select("disclosure_seq", urls.article_key(F.col("url")).alias("link"), urls.host(F.col("url")).alias("host"))


@query(f"""
SELECT d.disclosure_seq, h <> '' AND coalesce(list_aggregate(list_transform(c.official_domains, lambda a: a <> '' AND (h = a OR ends_with(h, '.' || a))), 'bool_or'), false) AS official
FROM (SELECT *, {_HOST} AS h FROM disclosures) d JOIN companies c USING (ticker)""")
def official_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document lies on one of its company's hosts."""
    c = table(spark, sf_dir, "companies").select("ticker", "official_domains")
    d = table(spark, sf_dir, "disclosures").select("disclosure_seq", "ticker", "url").join(c, "ticker")
    return d.select("disclosure_seq", urls.host_allowed(F.col("url"), F.col("official_domains")).alias("official"))


@query(r"""
SELECT doc_id, cjk, latin, cjk < 120 OR (latin > 0 AND cjk / (cjk + latin) < 0.22) AS predominantly_latin FROM (
  SELECT doc_id, (length(text) - length(regexp_replace(text, '[\x{3400}-\x{9fff}]', '', 'g')))::INT AS cjk, (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::INT AS latin
  FROM documents WHERE length(text) >= 240)""")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.language_issues(table(spark, sf_dir, "documents"), "doc_id")


_FOLDED = _fold("title")
_YEAR = rf"coalesce(nullif(fiscal_year, 0), try_cast(nullif(regexp_extract({_FOLDED}, '(20\d{{2}})', 1), '') AS INT))"
_QP = r"'(?:第?([1-4])四半期|q([1-4])|([1-4])q|([1-4])(?:st|nd|rd|th)\s+quarter)'"
_QDIGIT = "coalesce(" + ", ".join(f"nullif(regexp_extract({_FOLDED}, {_QP}, {g}), '')" for g in (1, 2, 3, 4)) + ")"
_QWORD = rf"CASE regexp_extract({_FOLDED}, '\b(first|second|third|fourth)\s+quarter\b', 1) WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' WHEN 'fourth' THEN '4' END"
_QUARTER = f"coalesce(nullif(quarter, ''), {_QDIGIT}, {_QWORD}, CASE WHEN {_YEAR} IS NOT NULL AND {_any(_FOLDED, ["annual", "full year", "year ended", "通期"])} THEN '4' END)"
_PERIODS = f"""
inferred AS (
  SELECT d.*, source || ':' || source_id AS document_key, {_YEAR} AS inferred_year,
    CASE WHEN coalesce(fiscal_year, 0) <> 0 AND coalesce(quarter, '') <> '' THEN upper(quarter) WHEN starts_with(upper({_QUARTER}), 'Q') THEN {_QUARTER} ELSE 'Q' || {_QUARTER} END AS inferred_quarter
  FROM disclosures d
)"""
_EVENT = "CASE WHEN coalesce(ticker, '') = '' THEN NULL WHEN coalesce(period_end, '') <> '' THEN concat_ws('_', ticker, period_end, inferred_quarter) WHEN coalesce(inferred_year, 0) <> 0 AND coalesce(inferred_quarter, '') <> '' THEN ticker || '_FY' || inferred_year || '_' || inferred_quarter END"


@query(f"WITH {_PERIODS} SELECT disclosure_seq, inferred_year, inferred_quarter, {_EVENT} AS event_id FROM inferred")
def inferred_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_event(events.with_period(table(spark, sf_dir, "disclosures"))).select("disclosure_seq", "inferred_year", "inferred_quarter", "event_id")


@query(r"""
SELECT disclosure_seq, CASE WHEN far IN (0, 1, 11) THEN 'Q4' WHEN far <= 4 THEN 'Q1' WHEN far <= 7 THEN 'Q2' ELSE 'Q3' END AS fiscal_quarter,
  (substr(period_end, 1, 4)::INT + CASE WHEN substr(period_end, 6, 2) || substr(period_end, 9, 2) > '0930' THEN 1 ELSE 0 END)::INT AS fiscal_year_of_end
FROM (SELECT *, (substr(period_end, 6, 2)::INT - 9 + 12) % 12 AS far FROM disclosures WHERE period_end IS NOT NULL)""")
def fiscal_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter and year of each period's end for a fiscal year that ends in September."""
    d = table(spark, sf_dir, "disclosures").where("period_end IS NOT NULL")
    return d.select("disclosure_seq", periods.quarter_of_period_end(F.col("period_end"), F.lit("0930")).alias("fiscal_quarter"), periods.fiscal_year_of(F.col("period_end"), F.lit("0930")).alias("fiscal_year_of_end"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as last delivered, with their period and the day that their publication's text begins with."""
    d = events.with_period(events.latest_deliveries(table(spark, sf_dir, "disclosures")))
    return d.withColumn("day", events.published_day(F.col("published_at")))


_LATEST = f"""
{_PERIODS}, latest AS (
  SELECT *, nullif(regexp_extract(published_at, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS day FROM (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY ingested_at DESC NULLS LAST, disclosure_seq) AS rn FROM inferred) WHERE rn = 1
), anchors AS (
  SELECT ticker, day, min((inferred_year, inferred_quarter, coalesce(period_end, ''))) AS lo, max((inferred_year, inferred_quarter, coalesce(period_end, ''))) AS hi,
    min(inferred_year) AS y, min(inferred_quarter) AS q, min(coalesce(period_end, '')) AS e
  FROM latest WHERE {_any('lower(title)', _RESULTS)} AND inferred_year IS NOT NULL AND inferred_quarter IS NOT NULL AND ticker IS NOT NULL AND day IS NOT NULL GROUP BY ALL
), aligned AS (
  SELECT l.* EXCLUDE (inferred_year, inferred_quarter, period_end), t AS aligned, CASE WHEN t THEN a.y ELSE l.inferred_year END AS inferred_year,
    CASE WHEN t THEN a.q ELSE l.inferred_quarter END AS inferred_quarter, CASE WHEN t THEN nullif(a.e, '') ELSE l.period_end END AS period_end
  FROM latest l LEFT JOIN (SELECT * FROM anchors WHERE lo = hi) a ON l.ticker = a.ticker AND l.day = a.day,
    LATERAL (SELECT a.ticker IS NOT NULL AND NOT (l.inferred_year IS NOT NULL AND l.inferred_quarter IS NOT NULL AND l.period_end IS NOT NULL) AS t)
), placed AS (SELECT *, {_EVENT} AS event_id FROM aligned)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_event(events.align_companions(deliveries(spark, sf_dir), "day"))


@query(f"WITH {_LATEST} SELECT disclosure_seq, inferred_year, inferred_quarter, period_end, aligned, event_id FROM placed")
def companion_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the period of their company's one result of the day where they have none of their own."""
    return placed(spark, sf_dir).select("disclosure_seq", "inferred_year", "inferred_quarter", "period_end", "aligned", "event_id")


@query(f"""
WITH {_LATEST}, keys AS (SELECT event_id, document_key, min(disclosure_seq) AS s FROM placed WHERE event_id IS NOT NULL GROUP BY ALL), lists AS (SELECT event_id, string_agg(document_key, ' ' ORDER BY s) AS document_keys FROM keys GROUP BY 1)
SELECT p.event_id, min(ticker) AS ticker, any_value(l.document_keys) AS document_keys, count(DISTINCT document_key) AS documents, arg_min(document_key, disclosure_seq) AS first_key, arg_min(inferred_year, disclosure_seq) AS fiscal_year,
  arg_min(inferred_quarter, disclosure_seq) AS quarter, arg_min(coalesce(p.period_end, '-'), disclosure_seq) AS period_end, max(disclosure_seq) AS last_seq FROM placed p JOIN lists l ON l.event_id = p.event_id GROUP BY p.event_id""")
def formed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their documents in the order in which they came."""
    e = events.form_events(placed(spark, sf_dir), "disclosure_seq")
    return e.withColumn("document_keys", F.array_join("document_keys", " ")).withColumn("period_end", F.coalesce("period_end", F.lit("-")))


_MIRROR = f"""
firsts AS (SELECT event_id, {_TITLE_KEY} AS tkey, min(disclosure_seq) AS first_seq FROM placed WHERE source NOT IN {_MIRRORS} AND coalesce(metadata.format, '') <> 'ixbrl' AND event_id IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_LATEST}, {_MIRROR} SELECT p.disclosure_seq, p.event_id FROM placed p LEFT JOIN firsts f ON f.event_id = p.event_id AND f.tkey = {_TITLE_KEY} WHERE NOT (source IN {_MIRRORS} AND coalesce(f.first_seq < p.disclosure_seq, false))")
def without_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.suppress_mirrors(placed(spark, sf_dir), "disclosure_seq").select("disclosure_seq", "event_id")


@query("SELECT document_key, count(*) AS deliveries FROM (SELECT source || ':' || source_id AS document_key FROM disclosures) WHERE document_key NOT IN (SELECT unnest(documents) FROM earnings_events WHERE documents IS NOT NULL) GROUP BY 1")
def unseen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no event names."""
    known = table(spark, sf_dir, "earnings_events").select(F.explode("documents").alias("document_key"))
    d = table(spark, sf_dir, "disclosures").select(events.document_key().alias("document_key"))
    return d.join(known, "document_key", "left_anti").groupBy("document_key").agg(count().alias("deliveries"))


@query(f"""
WITH {_LATEST}, known AS (SELECT DISTINCT unnest(documents) AS document_key FROM earnings_events WHERE updated_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'),
flagged AS (
  SELECT p.*, k.document_key IS NOT NULL AS is_known, ({_KIND}) <> 'other' OR coalesce(list_aggregate(list_transform(c.patterns, lambda x: contains(lower(p.title), x)), 'bool_or'), false) AS results
  FROM placed p LEFT JOIN companies c ON c.ticker = p.ticker LEFT JOIN known k ON k.document_key = p.document_key),
firsts AS (SELECT event_id, {_TITLE_KEY} AS tkey, min(disclosure_seq) AS first_seq FROM flagged WHERE results AND NOT is_known AND source NOT IN {_MIRRORS} AND coalesce(metadata.format, '') <> 'ixbrl' AND event_id IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN coalesce(p.ticker, '') = '' THEN 'unlisted' WHEN NOT results THEN 'not_results' WHEN is_known THEN 'seen' WHEN p.event_id IS NULL THEN 'ungroupable'
  WHEN source IN {_MIRRORS} AND coalesce(f.first_seq < p.disclosure_seq, false) THEN 'mirror' ELSE 'new' END AS outcome, count(*) AS documents
FROM flagged p LEFT JOIN firsts f ON f.event_id = p.event_id AND f.tkey = {_TITLE_KEY} GROUP BY 1""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are new, seen, mirrors and so on, if what events named before June 2025 is known."""
    known = table(spark, sf_dir, "earnings_events").where(F.col("updated_at") < F.lit("2025-06-01 00:00:00").cast("timestamp")).select(F.explode("documents").alias("document_key"))
    out = events.outcomes(placed(spark, sf_dir), known, table(spark, sf_dir, "companies"), "disclosure_seq")
    return out.groupBy("outcome").agg(count().alias("documents"))


_STATE = "state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC NULLS LAST, event_row DESC) AS rn FROM earnings_events) WHERE rn = 1)"


def current_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest_state(table(spark, sf_dir, "earnings_events"), "event_id", "updated_at", "event_row")


@query(f"WITH {_STATE} SELECT event_id, event_row, status, report_version, len(documents)::INT AS documents FROM state")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_events(spark, sf_dir).select("event_id", "event_row", "status", "report_version", F.when(F.col("documents").isNotNull(), F.size("documents")).alias("documents"))


@query(f"""
WITH {_STATE}, {_PERIODS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY ingested_at DESC NULLS LAST, disclosure_seq) AS rn FROM inferred) WHERE rn = 1)
SELECT s.event_id, u.at::INT AS place, l.disclosure_seq FROM state s, LATERAL (SELECT unnest(s.documents) AS document_key, generate_subscripts(s.documents, 1) AS at) u JOIN latest l ON l.document_key = u.document_key""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each event in their order."""
    e = current_events(spark, sf_dir).select("event_id", F.posexplode("documents").alias("at", "document_key"))
    d = events.latest_deliveries(table(spark, sf_dir, "disclosures")).select("document_key", "disclosure_seq")
    return e.join(d, "document_key").select("event_id", (F.col("at") + 1).alias("place"), "disclosure_seq")


_FLAGS = [("has_primary_results", "document_kind", ["financial_results", "financial_tables", "performance_review"]), ("has_official_ir", "source", ["official_ir", "gemini_grounded_ir", "openai_web_ir"]), ("has_transcript_or_qa", "document_kind", ["transcript", "qa", "prepared_remarks"]),
          ("has_transcript_enrichment", "source", ["alpha_vantage_transcript", "third_party_transcript"]), ("has_financial_tables", "document_kind", ["financial_tables"]), ("has_performance_review", "document_kind", ["performance_review"]), ("has_presentation", "document_kind", ["presentation"])]


@query(f"""
WITH {_LATEST}, k AS (SELECT event_id, document_kind, count(*) AS n FROM placed WHERE event_id IS NOT NULL GROUP BY ALL), s AS (SELECT event_id, source, count(*) AS n FROM placed WHERE event_id IS NOT NULL GROUP BY ALL)
SELECT event_id, count(*) AS documents, {", ".join(f"coalesce(bool_or({c} IN {_in(v)}), false) AS {n}" for n, c, v in _FLAGS)},
  (SELECT string_agg(coalesce(k.document_kind, '') || '=' || k.n, ';' ORDER BY coalesce(k.document_kind, '')) FROM k WHERE k.event_id = p.event_id) AS kinds,
  (SELECT string_agg(s.source || '=' || s.n, ';' ORDER BY s.source) FROM s WHERE s.event_id = p.event_id) AS sources
FROM placed p WHERE event_id IS NOT NULL GROUP BY event_id""")
def source_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events.manifest(placed(spark, sf_dir).where("event_id IS NOT NULL"), ["event_id"])
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return m.withColumn("kinds", flat("kinds")).withColumn("sources", flat("sources"))


@query("""
WITH c AS (SELECT disclosure_seq AS seq, ticker, ingested_at::TIMESTAMP::DATE AS day FROM disclosures WHERE metadata.form IN ('8-K', '6-K') AND ticker IS NOT NULL),
p AS (SELECT disclosure_seq AS pseq, ticker, ingested_at::TIMESTAMP::DATE AS pday, period_end FROM disclosures WHERE metadata.form IN ('10-Q', '10-K') AND period_end IS NOT NULL AND ticker IS NOT NULL)
SELECT c.seq, b.gap AS gap_days, b.pseq AS periodic_seq, b.period_end AS report_date FROM c LEFT JOIN (
  SELECT c.seq, abs(pday - day)::INT AS gap, pseq, period_end, row_number() OVER (PARTITION BY c.seq ORDER BY abs(pday - day), pseq) AS rn FROM c JOIN p ON p.ticker = c.ticker AND abs(pday - day) <= 3
) b ON b.seq = c.seq AND b.rn = 1""")
def nearest_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each current report, the nearest periodic report of its company within three days."""
    d = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL").select(F.col("disclosure_seq").alias("seq"), "ticker", F.to_date("ingested_at").alias("day"), F.col("metadata.form").alias("form"), "period_end")
    current = d.where(F.col("form").isin("8-K", "6-K")).select("seq", "ticker", "day")
    return events.nearest_periodic(current, d.where(F.col("form").isin("10-Q", "10-K")), "ticker", "day", "period_end").select("seq", "gap_days", "periodic_seq", "report_date")


@query("""
WITH f AS (SELECT DISTINCT ticker, period_end, metadata.form AS form FROM disclosures WHERE ticker IS NOT NULL AND period_end IS NOT NULL AND metadata.form IN ('10-Q', '10-K')),
q AS (SELECT d.ticker, d.period_end, coalesce((SELECT max(a.period_end) FROM f a WHERE a.ticker = d.ticker AND a.form = '10-K' AND a.period_end < d.period_end), '') AS last FROM f d WHERE form = '10-Q')
SELECT ticker, period_end, 'Q' || least(3, greatest(1, (SELECT count(DISTINCT x.period_end) FROM f x WHERE x.ticker = q.ticker AND x.form = '10-Q' AND x.period_end > q.last AND x.period_end <= q.period_end))) AS counted_quarter FROM q""")
def counted_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports numbered after their company's last annual one."""
    d = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL AND period_end IS NOT NULL").select("ticker", "period_end", F.col("metadata.form").alias("form")).where(F.col("form").isin("10-Q", "10-K")).distinct()
    return events.quarterly_count(d, "ticker", "period_end", "form").select("ticker", "period_end", "counted_quarter")


@query("SELECT disclosure_seq, ticker, row_number() OVER (PARTITION BY ticker ORDER BY ingested_at, disclosure_seq) AS position FROM disclosures WHERE ingested_at IS NOT NULL")
def positions_in_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery's position among its company's, without a whole company in one task."""
    d = table(spark, sf_dir, "disclosures").where("ingested_at IS NOT NULL").select("disclosure_seq", "ticker", "ingested_at")
    return numbered(d, ["ticker"], ["ingested_at", "disclosure_seq"]).select("disclosure_seq", "ticker", "position")


_EVEN = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
_PARTS = rf"list_filter(list_transform(string_split_regex({_EVEN}, '\n\s*\n'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"
_PROBE = _any("lower(coalesce(title, ''))", _CALL)
_EKIND = "lower(metadata.document_kind)"
_UNITS = rf"""
docs AS (
  SELECT evidence_id, document_key, {_EKIND} AS kind, {_EKIND} IN ('transcript', 'qa', 'prepared_remarks') OR {_PROBE} AS transcript, {_PARTS} AS parts FROM evidence
), parts AS (
  SELECT evidence_id, kind, transcript, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM docs
), spans AS (
  SELECT *, sum((transcript AND {_any('lower(p)', _QA)})::INT) OVER w AS marks, row_number() OVER w AS rn,
    max((transcript AND {_any('lower(p)', _QA)})::INT) OVER (PARTITION BY evidence_id ORDER BY i ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS mark
  FROM parts WINDOW w AS (PARTITION BY evidence_id ORDER BY i)
), pieces AS (
  SELECT evidence_id, kind, transcript, marks AS span, row_number() OVER (PARTITION BY evidence_id, marks ORDER BY i, k) AS ord, least(4000, length(p) - k * 4000) AS n, substr(p, k * 4000 + 1, 4000) AS t
  FROM spans, LATERAL (SELECT unnest(range(0, (length(p) - 1) // 4000 + 1)) AS k)
), fold AS (
  SELECT evidence_id, kind, transcript, span, ord, n::BIGINT AS size, 1 AS grp FROM pieces WHERE ord = 1
  UNION ALL SELECT p.evidence_id, p.kind, p.transcript, p.span, p.ord, CASE WHEN f.size + p.n + 2 > 4000 THEN p.n ELSE f.size + p.n + 2 END, f.grp + (f.size + p.n + 2 > 4000)::INT
  FROM fold f JOIN pieces p ON p.evidence_id = f.evidence_id AND p.span = f.span AND p.ord = f.ord + 1
), units AS (
  SELECT evidence_id, row_number() OVER (PARTITION BY evidence_id ORDER BY span, grp)::INT AS position, CASE WHEN transcript AND span > 0 THEN 'qa' WHEN transcript THEN 'prepared_remarks' ELSE kind END AS phase, max(size)::INT AS n_chars, span, grp
  FROM fold GROUP BY evidence_id, kind, transcript, span, grp
), unit_texts AS (
  SELECT u.evidence_id, u.position, u.phase, string_agg(p.t, chr(10) || chr(10) ORDER BY p.ord) AS unit
  FROM units u JOIN fold f ON f.evidence_id = u.evidence_id AND f.span = u.span AND f.grp = u.grp JOIN pieces p ON p.evidence_id = f.evidence_id AND p.span = f.span AND p.ord = f.ord GROUP BY ALL
), named_units AS (
  SELECT u.*, e.document_key, e.document_key || '#u' || u.position AS unit_id FROM unit_texts u JOIN evidence e ON e.evidence_id = u.evidence_id
)"""


def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitize.units(spread(table(spark, sf_dir, "evidence")))


@query(f"WITH RECURSIVE {_UNITS} SELECT evidence_id, position, phase, n_chars FROM units")
def unit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of evidence texts: whole paragraphs in blocks of at most 4,000 characters."""
    return evidence_units(spark, sf_dir).where("position > 0").select("evidence_id", "position", "phase", "n_chars")


@query(f"""
WITH RECURSIVE {_UNITS} SELECT u.unit_id, u.document_key, coalesce(e.title, '') AS title, coalesce(e.metadata.source, '') AS source, coalesce(e.metadata.document_kind, '') AS document_kind, u.phase, u.position,
  md5(u.unit) AS digest, '' AS related_official_context FROM named_units u JOIN evidence e ON e.evidence_id = u.evidence_id""")
def unit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as an extraction model gets them, their texts as digests."""
    rows = unitize.unit_payload(evidence_units(spark, sf_dir).where("position > 0"), table(spark, sf_dir, "evidence"))
    return rows.withColumn("digest", F.md5("text")).drop("text")


@query(f"""
WITH RECURSIVE {_UNITS}, b AS (
  SELECT evidence_id, position, n_chars::BIGINT AS size, 1 AS items, 1 AS batch FROM units WHERE position = 1
  UNION ALL SELECT u.evidence_id, u.position, CASE WHEN b.items >= 2 OR b.size + u.n_chars > 8000 THEN u.n_chars ELSE b.size + u.n_chars END, CASE WHEN b.items >= 2 OR b.size + u.n_chars > 8000 THEN 1 ELSE b.items + 1 END,
    b.batch + (b.items >= 2 OR b.size + u.n_chars > 8000)::INT FROM b JOIN units u ON u.evidence_id = b.evidence_id AND u.position = b.position + 1
) SELECT b.evidence_id, e.document_key || '#u' || b.position AS unit_id, b.position, b.batch FROM b JOIN evidence e ON e.evidence_id = b.evidence_id""")
def unit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text unit's batch of at most two units and 8,000 characters."""
    return unitize.batches(evidence_units(spark, sf_dir).where("position > 0"))


@query(f"""
WITH RECURSIVE {_UNITS} SELECT e.evidence_id, coalesce(nullif(metadata.raw_chars, 0), length(text), 0)::INT AS raw_chars, coalesce(length(text), 0)::INT AS extracted_chars, len({_PARTS})::INT AS raw_paragraphs,
  (SELECT count(*) FROM units u WHERE u.evidence_id = e.evidence_id) + (len(coalesce(structured_facts, [])) > 0)::INT AS units, (SELECT count(*) FROM units u WHERE u.evidence_id = e.evidence_id AND phase IN ('prepared_remarks', 'qa')) AS call_units
FROM evidence e""")
def unit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence")
    return unitize.unit_manifest(e, stored(unitize.units(e), "units")).select("evidence_id", "raw_chars", "extracted_chars", "raw_paragraphs", "units", "call_units")


@query(f"""
WITH RECURSIVE {_UNITS}, e AS (SELECT DISTINCT document_key, unit_id FROM (SELECT document_key, unit_id FROM named_units UNION ALL SELECT document_key, document_key || '#structured' FROM evidence WHERE len(structured_facts) > 0)),
p AS (SELECT DISTINCT document_key, unit_id FROM cards WHERE document_key IN (SELECT document_key FROM evidence)),
c AS (SELECT coalesce(e.document_key, p.document_key) AS document_key, count(e.unit_id) AS expected, count(*) FILTER (WHERE e.unit_id IS NOT NULL AND p.unit_id IS NOT NULL) AS processed, count(*) FILTER (WHERE p.unit_id IS NULL) AS missing, count(*) FILTER (WHERE e.unit_id IS NULL) AS unexpected
  FROM e FULL JOIN p ON e.document_key = p.document_key AND e.unit_id = p.unit_id GROUP BY 1)
SELECT *, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE round_even(processed / expected, 6) END AS ratio,
  missing = 0 AND unexpected = 0 AND document_key NOT IN (SELECT document_key FROM evidence WHERE metadata.truncated AND document_key IS NOT NULL) AS complete FROM c""")
def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document's units by the units that cards name."""
    e = table(spark, sf_dir, "evidence")
    u = unitize.units(e).join(e.select("evidence_id", "document_key"), "evidence_id").select("document_key", "unit_id")
    done = table(spark, sf_dir, "cards").select("document_key", "unit_id").join(e.select("document_key"), "document_key", "left_semi")
    return unitize.coverage(u, done, ["document_key"], e.where("metadata.truncated"))


_SECTIONS = rf"""
sdocs AS (SELECT evidence_id, document_key, {_any("lower(coalesce(title, '')) || chr(10) || lower(left(coalesce(text, ''), 4000))", [*_CALL, "question and answer"])} AS call,
    {_any("lower(coalesce(title, ''))", ["q&a", "question-and-answer", "questions and answers"])} AS titled, {_PARTS} AS parts FROM evidence),
sparts AS (SELECT evidence_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM sdocs),
spieces AS (SELECT evidence_id, row_number() OVER (PARTITION BY evidence_id ORDER BY i, k) AS ord, least(7500, length(p) - k * 7500) AS n, substr(p, k * 7500 + 1, 7500) AS t FROM sparts, LATERAL (SELECT unnest(range(0, (length(p) - 1) // 7500 + 1)) AS k)),
sfold AS (
  SELECT evidence_id, ord, n::BIGINT AS size, 1 AS grp FROM spieces WHERE ord = 1
  UNION ALL SELECT p.evidence_id, p.ord, CASE WHEN f.size + p.n + 2 > 7500 THEN p.n ELSE f.size + p.n + 2 END, f.grp + (f.size + p.n + 2 > 7500)::INT FROM sfold f JOIN spieces p ON p.evidence_id = f.evidence_id AND p.ord = f.ord + 1
), stexts AS (SELECT f.evidence_id, f.grp AS position, string_agg(p.t, chr(10) || chr(10) ORDER BY p.ord) AS section FROM sfold f JOIN spieces p ON p.evidence_id = f.evidence_id AND p.ord = f.ord GROUP BY ALL),
sections AS (
  SELECT d.document_key || '#s' || x.position AS section_id, x.evidence_id, x.position::INT AS position, length(section)::INT AS n_chars, md5(section) AS digest,
    CASE WHEN call AND (titled OR coalesce(x.position >= min(CASE WHEN {_any("lower(section)", _QA)} THEN x.position END) OVER (PARTITION BY x.evidence_id), false)) THEN 'qa' WHEN call THEN 'transcript' ELSE 'document' END AS kind
  FROM stexts x JOIN sdocs d ON d.evidence_id = x.evidence_id)"""


@query(f"WITH RECURSIVE {_SECTIONS} SELECT section_id, evidence_id, position, kind, n_chars, digest FROM sections")
def evidence_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of at most 7,500 characters of evidence texts."""
    return unitize.sections(table(spark, sf_dir, "evidence")).select("section_id", "evidence_id", "position", "kind", "n_chars", F.md5("section").alias("digest"))


@query(f"""
WITH RECURSIVE {_SECTIONS}, parts2 AS (SELECT *, CASE WHEN kind = 'qa' THEN 'qa' ELSE 'rest' END AS part, row_number() OVER (PARTITION BY evidence_id, kind = 'qa' ORDER BY position) AS ord, sum(n_chars) OVER (PARTITION BY evidence_id) AS total FROM sections),
gfold AS (
  SELECT evidence_id, part, ord, n_chars::BIGINT AS size, 1 AS grp FROM parts2 WHERE ord = 1
  UNION ALL SELECT p.evidence_id, p.part, p.ord, CASE WHEN f.size + p.n_chars > 22000 THEN p.n_chars ELSE f.size + p.n_chars END, f.grp + (f.size + p.n_chars > 22000)::INT FROM gfold f JOIN parts2 p ON p.evidence_id = f.evidence_id AND p.part = f.part AND p.ord = f.ord + 1
), sizes AS (SELECT evidence_id, coalesce(max(grp) FILTER (WHERE part = 'qa'), 0) AS q, coalesce(max(grp) FILTER (WHERE part = 'rest'), 0) AS r FROM gfold GROUP BY 1),
slots AS (SELECT *, least(q, 3) AS qs, 6 - least(q, 3) AS rs FROM sizes)
SELECT p.evidence_id, p.section_id, p.kind, p.part, f.grp FROM parts2 p JOIN gfold f ON f.evidence_id = p.evidence_id AND f.part = p.part AND f.ord = p.ord JOIN slots s ON s.evidence_id = p.evidence_id
WHERE p.total <= 22000 OR (CASE WHEN p.part = 'qa' THEN q ELSE r END) <= (CASE WHEN p.part = 'qa' THEN qs ELSE rs END)
  OR list_contains(list_transform(range(0, CASE WHEN p.part = 'qa' THEN qs ELSE rs END), lambda i: round_even(i * ((CASE WHEN p.part = 'qa' THEN q ELSE r END) - 1) / ((CASE WHEN p.part = 'qa' THEN qs ELSE rs END) - 1), 0)::INT), f.grp - 1)""")
def extraction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document that are sent for extraction, by group."""
    return unitize.chosen_groups(unitize.sections(table(spark, sf_dir, "evidence")))


_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(c, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\n[ \t\n\x0b\f\r]*\n|\x01'), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(rf"""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS c FROM documents WHERE coalesce(document_kind, '') NOT IN ('transcript', 'question')),
s AS (SELECT doc_id, c, list_filter({_SENTENCES}, lambda x: {_any("lower(x)", _SIGNALS)}) AS told FROM t),
x AS (SELECT doc_id, unnest(CASE WHEN len(told) > 0 THEN told ELSE [c] END) AS x, generate_subscripts(CASE WHEN len(told) > 0 THEN told ELSE [c] END, 1) AS i FROM s),
b AS (SELECT *, 24000 - coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM x WHERE x <> '')
SELECT t.doc_id, coalesce(left(string_agg(left(x, room::BIGINT), chr(10) || chr(10) ORDER BY i) FILTER (WHERE room > 0), 24000), '') AS compressed FROM t LEFT JOIN b ON b.doc_id = t.doc_id GROUP BY 1""")
def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't calls in the sentences that hold a signal word, within 24,000 characters."""
    d = table(spark, sf_dir, "documents").where(~F.coalesce(F.col("document_kind").isin("transcript", "question"), F.lit(False)))
    return d.select("doc_id", unitize.compress_text(F.col("text")).alias("compressed"))


_SCORE = rf"""(({" + ".join(f"(length(lower(pg)) - length(replace(lower(pg), '{w}', ''))) // {len(w)}" for w in _SIGNALS)}) * 4 + least(len(regexp_extract_all(pg, '(?:^|{_EDGE})\d[\d,]*(?:\.\d+)?%?')), 40) * 0.6
  + len(regexp_extract_all(regexp_replace(lower(pg), '({_EDGE})', '\1\1', 'g'), '(?:^|{_EDGE})(?:q[1-4]|fy(?:\s\s)?20\d{{2}}|20\d{{2}})(?:$|{_EDGE})')) * 0.5)"""


@query(rf"""
WITH d AS (SELECT doc_id, {_PARTS} AS parts FROM documents WHERE document_kind IN ('transcript', 'question')),
pages AS (SELECT doc_id, i, array_to_string(parts[i * 12 + 1 : i * 12 + 12], chr(10) || chr(10)) AS pg, (len(parts) + 11) // 12 AS n FROM d, LATERAL (SELECT unnest(range(0, (len(parts) + 11) // 12)) AS i)),
marked AS (SELECT *, min(CASE WHEN {_any("lower(pg)", _QA)} THEN i END) OVER (PARTITION BY doc_id) AS first_mark, {_SCORE} AS score, '[[PAGE ' || (i + 1) || ']]' || chr(10) || pg AS shown FROM pages),
split AS (SELECT *, coalesce(first_mark, greatest(1, n - greatest(4, n // 3))) AS start FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i >= start ORDER BY score DESC, i) AS place FROM split),
kept AS (SELECT *, i >= start AS asked FROM ranked WHERE i >= start OR i = 0 OR place <= 5),
used AS (SELECT *, (CASE WHEN asked THEN 31280 ELSE 14720 END) - coalesce(sum(length(shown) + 2) OVER (PARTITION BY doc_id, asked ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM kept),
halves AS (SELECT doc_id, left(string_agg(left(shown, room::BIGINT), chr(10) || chr(10) ORDER BY i) FILTER (WHERE asked AND room > 0), 31280) AS a, left(string_agg(left(shown, room::BIGINT), chr(10) || chr(10) ORDER BY i) FILTER (WHERE NOT asked AND room > 0), 14720) AS b FROM used GROUP BY 1)
SELECT d.doc_id, (len(parts) + 11) // 12 AS n_pages, left(concat_ws(chr(10) || chr(10), nullif(trim(a, ' '), ''), nullif(trim(left(b, 46000 - coalesce(length(a) + 2, 0)), ' '), '')), 46000) AS compressed FROM d LEFT JOIN halves h ON h.doc_id = d.doc_id""")
def compressed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in pages of a dozen paragraphs, the questions first, within 46,000 characters."""
    d = table(spark, sf_dir, "documents").where(F.col("document_kind").isin("transcript", "question")).select("doc_id", unitize.pseudo_pages(F.col("text")).alias("pages"))
    return d.select("doc_id", F.size("pages").cast("long").alias("n_pages"), unitize.compress_call(F.col("pages")).alias("compressed"))


@query(rf"""
WITH d AS (SELECT doc_id, doc_id % 2 = 0 AS deck, {_PARTS} AS parts FROM documents WHERE coalesce(document_kind, '') NOT IN ('transcript', 'question')),
pages AS (SELECT doc_id, deck, i, array_to_string(parts[i * 12 + 1 : i * 12 + 12], chr(10) || chr(10)) AS pg FROM d, LATERAL (SELECT unnest(range(0, (len(parts) + 11) // 12)) AS i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_SCORE} DESC, i) AS place, '[[PAGE ' || (i + 1) || ']]' || chr(10) || pg AS shown FROM pages),
used AS (SELECT *, CASE WHEN deck THEN 30000 ELSE 24000 END AS most, CASE WHEN deck THEN 30000 ELSE 24000 END - coalesce(sum(length(shown) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM ranked WHERE i < CASE WHEN deck THEN 2 ELSE 1 END OR place <= CASE WHEN deck THEN 10 ELSE 8 END)
SELECT d.doc_id, coalesce(left(string_agg(left(shown, room::BIGINT), chr(10) || chr(10) ORDER BY i) FILTER (WHERE room > 0), any_value(most)), '') AS compressed FROM d LEFT JOIN used u ON u.doc_id = d.doc_id GROUP BY 1""")
def compressed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't calls in their best pages, as decks and as documents: the first pages and those of highest score."""
    d = table(spark, sf_dir, "documents").where(~F.coalesce(F.col("document_kind").isin("transcript", "question"), F.lit(False))).select("doc_id", unitize.pseudo_pages(F.col("text")).alias("pages"))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, unitize.compress_deck(F.col("pages"))).otherwise(unitize.compress_document(F.col("pages"))).alias("compressed"))


def ranked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.ranked(table(spark, sf_dir, "cards"))


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({_fold(f"coalesce({c}, '')")}, '{_WS}+', ' ', 'g'))"


_FP = "array_to_string(list_filter([" + ", ".join(_squeeze(c) for c in ("card_type", "topic", "metric", "coalesce(value_num::VARCHAR, value_text)", "unit", "period", "reported_change", "statement", "question_summary", "answer_summary")) + "], lambda x: x <> ''), '|')"
_RANK = "CASE WHEN lower(provenance) = 'third_party_transcript' THEN 55 ELSE coalesce(CASE lower(source) " + "WHEN 'sec_edgar' THEN 100 WHEN 'official_ir' THEN 95 WHEN 'gemini_grounded_ir' THEN 94 WHEN 'openai_web_ir' THEN 94 WHEN 'company_ir' THEN 94 WHEN 'alpha_vantage_transcript' THEN 65 WHEN 'third_party_transcript' THEN 55" + " END, 70) END"
_DEDUPED = f"""
ranked AS (SELECT *, coalesce(nullif({_FP}, ''), 'card ' || card_seq) AS fp, {_RANK} AS rank, greatest(1, least(5, coalesce(nullif(materiality_candidate, 0), 1))) AS mat, coalesce(nullif(topic, ''), 'other') AS topic_key FROM cards),
deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fp ORDER BY rank DESC, mat DESC, card_seq) AS rn, min(card_seq) OVER (PARTITION BY ticker, fp) AS first_seq, count(*) OVER (PARTITION BY ticker, fp) AS copies FROM ranked) WHERE rn = 1)"""


@query(f"WITH {_DEDUPED} SELECT ticker, card_seq, first_seq, copies FROM deduped")
def deduped_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card for each fingerprint of a company: the best source, then the most material, then the first."""
    return cards.dedupe(ranked_cards(spark, sf_dir), ["ticker"], keep=[]).select("ticker", "card_seq", "first_seq", "copies")


_TOPICS = "'demand_revenue', 'guidance', 'margin_unit_economics', 'cash_capex', 'customer_usage', 'product_competition', 'supply_capacity', 'qa_management', 'risk', 'other'"
_TOPIC_RANK = f"coalesce(list_position([{_TOPICS}], topic_key) - 1, 10)"
_SELECTED = f"""
{_DEDUPED}, flagged AS (SELECT *, mat >= 4 OR coalesce(card_type, '') = 'guidance' OR (coalesce(card_type, '') = 'qa' AND mat >= 3) AS must FROM deduped),
have AS (SELECT ticker, topic_key, count(*) AS n FROM flagged WHERE must GROUP BY ALL), total AS (SELECT ticker, count(*) AS n FROM flagged WHERE must GROUP BY ALL),
opt AS (SELECT *, row_number() OVER (PARTITION BY ticker, topic_key ORDER BY mat DESC, rank DESC, coalesce(position, 0), first_seq) AS in_topic, row_number() OVER (PARTITION BY ticker ORDER BY mat DESC, rank DESC, coalesce(position, 0), first_seq) AS overall FROM flagged WHERE NOT must),
quota AS (
  SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.ticker ORDER BY {_TOPIC_RANK.replace("topic_key", "o.topic_key")}, in_topic) AS n2, coalesce(t.n, 0) AS musts
    FROM opt o LEFT JOIN have h ON h.ticker IS NOT DISTINCT FROM o.ticker AND h.topic_key = o.topic_key LEFT JOIN total t ON t.ticker IS NOT DISTINCT FROM o.ticker
    WHERE o.topic_key IN ({_TOPICS}) AND in_topic <= (CASE WHEN o.topic_key IN ('demand_revenue', 'guidance', 'margin_unit_economics', 'qa_management', 'risk') THEN 4 ELSE 2 END) - coalesce(h.n, 0)) WHERE n2 + musts <= 90),
taken AS (SELECT ticker, count(*) AS n FROM quota GROUP BY ALL),
fill AS (
  SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.ticker ORDER BY overall) AS n2, coalesce(t.n, 0) + coalesce(k.n, 0) AS before
    FROM opt o LEFT JOIN total t ON t.ticker IS NOT DISTINCT FROM o.ticker LEFT JOIN taken k ON k.ticker IS NOT DISTINCT FROM o.ticker WHERE o.card_seq NOT IN (SELECT card_seq FROM quota)) WHERE n2 + before <= 90)"""


@query(f"WITH {_SELECTED} SELECT ticker, card_seq, 'mandatory' AS why FROM flagged WHERE must UNION ALL SELECT ticker, card_seq, 'quota' FROM quota UNION ALL SELECT ticker, card_seq, 'fill' FROM fill")
def selected_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards for a company's report: all mandatory ones, a few of each topic, and the best of the rest up to ninety."""
    return cards.select(stored(cards.dedupe(ranked_cards(spark, sf_dir), ["ticker"], keep=cards.SELECTION), "deduped"), "ticker").select("ticker", "card_seq", "why")


@query(f"""
WITH {_SELECTED}, s AS (SELECT ticker, card_seq FROM flagged WHERE must UNION ALL SELECT ticker, card_seq FROM quota UNION ALL SELECT ticker, card_seq FROM fill)
SELECT s.ticker, s.card_seq, row_number() OVER (PARTITION BY s.ticker ORDER BY {_TOPIC_RANK}, mat DESC, coalesce(unit_id, ''), s.card_seq)::INT AS place FROM s JOIN deduped d ON d.card_seq = s.card_seq""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected cards in the order of their company's report: by topic, the most material first."""
    chosen = cards.select(stored(cards.dedupe(ranked_cards(spark, sf_dir), ["ticker"], keep=cards.SELECTION), "deduped"), "ticker")
    topic, mat, unit = cards.report_order()
    keyed = chosen.select("ticker", "card_seq", topic.alias("topic"), mat.alias("mat"), unit.alias("unit"))
    return numbered(keyed, ["ticker"], ["topic", "mat", "unit", "card_seq"], "place").select("ticker", "card_seq", F.col("place").cast("int").alias("place"))


@query(f"WITH {_DEDUPED} SELECT ticker, topic_key AS topic, count(*) AS cards FROM deduped GROUP BY ALL")
def topic_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.inventory(cards.dedupe(ranked_cards(spark, sf_dir), ["ticker"], keep=["topic"]), ["ticker"])


@query(f"""
WITH {_SELECTED}, raw AS (SELECT ticker, count(*) AS n FROM cards GROUP BY ALL), d AS (SELECT ticker, count(*) AS n FROM deduped GROUP BY ALL),
s AS (SELECT ticker, count(*) AS n FROM (SELECT ticker FROM flagged WHERE must UNION ALL SELECT ticker FROM quota UNION ALL SELECT ticker FROM fill) GROUP BY ALL)
SELECT raw.ticker, raw.n AS raw_cards, d.n AS deduped_cards, s.n AS selected_cards, greatest(0, d.n - s.n) AS omitted_cards FROM raw JOIN d ON d.ticker IS NOT DISTINCT FROM raw.ticker JOIN s ON s.ticker IS NOT DISTINCT FROM raw.ticker""")
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ranked_cards(spark, sf_dir)
    deduped = stored(cards.dedupe(raw, ["ticker"], keep=cards.SELECTION), "deduped")
    return cards.diagnostics(raw, deduped, cards.select(deduped, "ticker"), "ticker")


_SHORT = ["card_id", "card_type", "topic", "statement", "metric", "value_text", "unit", "period", "reported_change", "fact_class", "speaker", "analyst", "management_speaker", "question_summary", "answer_summary", "source", "provenance", "unit_id", "document_key", "quote", "guidance_type", "metric_type"]


@query(f"""
SELECT card_seq, ({" + ".join(f"(coalesce({c}, '') <> '')::INT" for c in _SHORT)} + {" + ".join(f"({c} IS NOT NULL)::INT" for c in ("value_num", "low", "midpoint", "high", "materiality_candidate"))} + (len(coalesce(reconciliation, [])) > 0)::INT)::INT AS fields,
  left(nullif(statement, ''), 360) AS statement, left(nullif(quote, ''), 240) AS quote, left(nullif(question_summary, ''), 280) AS asked, left(nullif(answer_summary, ''), 420) AS answered, low::DOUBLE AS low FROM cards""")
def compact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in short, as their JSON says it."""
    c = cards.compact(table(spark, sf_dir, "cards"))
    field = lambda n, name=None: F.get_json_object("card", f"$.{n}").alias(name or n)
    return c.select("card_seq", F.size(F.json_object_keys("card")).alias("fields"), field("statement"), field("quote"), field("question_summary", "asked"), field("answer_summary", "answered"), F.get_json_object("card", "$.low").cast("double").alias("low"))


@query("""
WITH c AS (SELECT ticker, card_seq, unnest(list_filter([CASE WHEN card_type = 'guidance' THEN 'guidance' END, CASE WHEN card_type = 'qa' THEN 'qa' END, CASE WHEN metric <> '' AND coalesce(card_type, '') <> 'guidance' THEN 'facts' END,
  CASE WHEN metric <> '' AND coalesce(card_type, '') <> 'guidance' AND topic = 'cash_capex' THEN 'cash_flow_and_capex' END], lambda x: x IS NOT NULL)) AS category FROM cards)
SELECT * FROM (SELECT ticker, category, card_seq, row_number() OVER (PARTITION BY ticker, category ORDER BY card_seq)::INT AS place FROM c)
WHERE place <= CASE category WHEN 'facts' THEN 120 WHEN 'qa' THEN 40 ELSE 30 END""")
def card_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cards of each category of a company."""
    rows = cards.categories(table(spark, sf_dir, "cards").select("ticker", "card_seq", "card_type", "metric", "topic"))
    return cards.bounded(rows, ["ticker"], "category", [F.col("card_seq")], cards.VIEW_LIMITS).select("ticker", "category", "card_seq", "place")


@query(f"""
WITH RECURSIVE {_UNITS}, u AS (SELECT unit_id, any_value(document_key) AS document_key, min(position) AS position FROM named_units GROUP BY 1),
s AS (SELECT e.document_key, min(e.metadata.source) AS source FROM evidence e GROUP BY 1)
SELECT card_seq, 'c' || card_seq || ':' || c.unit_id AS card_id, u.document_key, coalesce(s.source, '') AS source, CASE WHEN contains(lower(s.source), 'third_party') THEN 'third_party_transcript' ELSE 'primary_or_official' END AS provenance, u.position, trim(coalesce(quote, ''), ' ') AS quote
FROM cards c JOIN u ON u.unit_id = c.unit_id LEFT JOIN s ON s.document_key = u.document_key""")
def decorated_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of known units with what their unit tells of them."""
    e = table(spark, sf_dir, "evidence")
    u = evidence_units(spark, sf_dir).where("position > 0").select("evidence_id", "unit_id", "position").join(e.select("evidence_id", "document_key"), "evidence_id")
    s = e.groupBy("document_key").agg(F.min("metadata.source").alias("source"))
    u = u.groupBy("unit_id").agg(F.min("document_key").alias("document_key"), F.min("position").alias("position")).join(s, "document_key", "left")
    got = cards.decorated(table(spark, sf_dir, "cards"), u, F.col("card_seq"))
    return got.select("card_seq", "card_id", "document_key", "source", "provenance", "position", "quote")


def _strip(c: str) -> str:
    return rf"regexp_replace({_fold(f"coalesce({c}, '')")}, '{_WS}+', '', 'g')"


@query(f"""
SELECT c.card_seq, c.document_key FROM cards c JOIN evidence e USING (document_key) WHERE c.quote IS NOT NULL AND length({_strip("c.quote")}) >= 16
GROUP BY ALL HAVING NOT bool_or(contains({_strip("e.text")}, {_strip("c.quote")}))""")
def missing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose quote isn't in the evidence of their document."""
    return cards.quotes_missing(table(spark, sf_dir, "cards"), table(spark, sf_dir, "evidence"))


@query(f"""
WITH m AS (SELECT c.card_seq, any_value(c.ticker) AS ticker FROM cards c JOIN evidence e USING (document_key) WHERE c.quote IS NOT NULL AND length({_strip("c.quote")}) >= 16 GROUP BY 1 HAVING NOT bool_or(contains({_strip("e.text")}, {_strip("c.quote")})))
SELECT * FROM (SELECT ticker, card_seq, row_number() OVER (PARTITION BY ticker ORDER BY card_seq)::INT AS place FROM m) WHERE place <= 30""")
def quote_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty cards of each company whose quote isn't in the evidence of their document."""
    c = table(spark, sf_dir, "cards")
    lost = cards.quotes_missing(c, table(spark, sf_dir, "evidence")).join(c.select("card_seq", "ticker"), "card_seq")
    return cards.first_issues(lost, ["ticker"], [F.col("card_seq")]).select("ticker", "card_seq", "place")


_FACTS = """facts AS (
  SELECT card_seq, coalesce(low, CASE WHEN card_seq % 5 = 0 THEN value_num END) AS low, CASE WHEN card_seq % 3 = 0 THEN high ELSE midpoint END AS midpoint, high, guidance_type, quote, reconciliation,
    CASE WHEN card_seq % 2 = 0 THEN 'Adjusted ' || metric ELSE metric END AS metric, CASE WHEN card_seq % 7 = 0 THEN 'standard_fcf' ELSE metric_type END AS metric_type FROM cards)"""
_ADJ = "contains(lower(coalesce(metric, '')), 'adjusted')"
_MTYPE = "lower(coalesce(metric_type, ''))"


@query(rf"""
WITH {_FACTS} SELECT card_seq, issue FROM (
  SELECT card_seq, 'incomplete_range' AS issue FROM facts WHERE (low IS NULL) <> (high IS NULL)
    AND NOT ((coalesce(guidance_type, '') = 'lower_bound' AND high IS NULL AND regexp_matches(lower(coalesce(quote, '')), '(at least|more than|over|minimum)|至少|以上|超過')) OR (coalesce(guidance_type, '') = 'upper_bound' AND low IS NULL AND regexp_matches(lower(coalesce(quote, '')), '(at most|less than|up to|maximum)|至多|以下|低於')))
  UNION ALL SELECT card_seq, 'midpoint_not_range_average' FROM facts WHERE abs(midpoint - (low + high) / 2) > greatest(1e-9, abs((low + high) / 2) * 0.002)
  UNION ALL SELECT card_seq, 'adjusted_metric_taxonomy_mismatch' FROM facts WHERE {_ADJ} AND {_MTYPE} NOT IN ('adjusted_fcf', 'other_adjusted', 'adjusted')
  UNION ALL SELECT card_seq, 'adjusted_mislabelled_standard' FROM facts WHERE {_ADJ} AND {_MTYPE} = 'standard_fcf'
  UNION ALL SELECT card_seq, 'adjusted_metric_missing_reconciliation' FROM facts WHERE ({_ADJ} OR {_MTYPE} = 'adjusted_fcf') AND len(coalesce(reconciliation, [])) = 0
  UNION ALL SELECT card_seq, 'market_consensus_without_provider' FROM cards WHERE len(reconciliation) > 0)""")
def fact_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of facts made of cards, of which some have ranges with one end, wrong midpoints and adjusted metrics; reconciliations stand for a market consensus."""
    c, n = table(spark, sf_dir, "cards"), F.col("card_seq")
    facts = c.select(
        "card_seq", F.coalesce("low", F.when(n % 5 == 0, F.col("value_num"))).alias("low"), F.when(n % 3 == 0, F.col("high")).otherwise(F.col("midpoint")).alias("midpoint"), "high", "guidance_type", "quote", "reconciliation",
        F.when(n % 2 == 0, F.concat(F.lit("Adjusted "), "metric")).otherwise(F.col("metric")).alias("metric"), F.when(n % 7 == 0, "standard_fcf").otherwise(F.col("metric_type")).alias("metric_type"),
    )
    return checks.fact_issues(facts).unionAll(checks.consensus_issues(c, "card_seq", "reconciliation"))


def _rates(c: str) -> str:
    """Rates of a text without lookaround: each character that is in no rate is doubled, so that neighbouring matches share none."""
    found = rf"regexp_extract_all(regexp_replace(coalesce({c}, ''), '([^\w.%])', '\1\1', 'g'), '(?i)(^|[^\w.])([+-]?\d[\d,]*(\.\d+)?)\s*(%|bps?)($|[^A-Za-z])', 0)"
    number = r"regexp_extract(x, '([+-]?\d[\d,]*(\.\d+)?)\s*(%|[Bb][Pp])', 1)"
    plain = f"regexp_replace(replace({number}, ',', '')::DECIMAL(38,12)::VARCHAR, '[.]?0+$', '')"
    return f"list_distinct(list_transform({found}, lambda x: {plain} || CASE WHEN contains(x, '%') THEN '%' ELSE 'bps' END))"


@query(rf"""
WITH c AS (SELECT card_seq, {_rates("statement")} AS said, {_rates("quote")} AS held, quote, nullif(regexp_extract(reported_change, '(-?\d+(\.\d+)?)', 1), '') AS n FROM cards),
b AS (SELECT *, CASE WHEN n IS NOT NULL AND regexp_matches(coalesce(quote, ''), '(^|[^\d.])' || replace(ltrim(n, '-'), '.', '\.') || '($|[^\d.])') THEN [n || '%', ltrim(n, '-') || '%'] ELSE [] END AS more FROM c)
SELECT card_seq, unnest(list_filter(said, lambda x: NOT list_contains(held, x) AND NOT list_contains(more, x))) AS rate FROM b""")
def unbacked_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in a card's statement that neither its quote holds nor its reported change, where the quote holds that number."""
    c = table(spark, sf_dir, "cards").select("card_seq", "statement", "quote", F.nullif(F.regexp_extract("reported_change", r"(-?\d+(\.\d+)?)", 1), F.lit("")).alias("change"))
    return checks.unbacked_rates(c, "card_seq", "statement", "quote", "change")


_LINES = rf"""
raw_lines AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]')) AS raw, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'), 1)::INT AS line_no FROM documents),
lines AS (SELECT * FROM (SELECT doc_id, line_no, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS line FROM raw_lines) WHERE line <> '')"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.lines(table(spark, sf_dir, "documents"), "doc_id")


@query(rf"WITH {_LINES} SELECT doc_id, normal, count(*) AS times FROM (SELECT doc_id, {_squeeze('''regexp_replace(line, '^[•❓💬└-]+[ \t\n\f\r]*', '')''')} AS normal FROM lines) WHERE length(normal) >= 28 GROUP BY ALL HAVING count(*) >= 2")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repeated_lines(document_lines(spark, sf_dir), ["doc_id"])


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE starts_with(line, '•') OR starts_with(line, '- ')) AS bullets, sum(length(line))::BIGINT AS chars FROM lines GROUP BY 1")
def line_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.density(document_lines(spark, sf_dir), "doc_id")


_HEADING = r"regexp_matches(line, '^[A-Z][A-Z &,]{5,60}$')"


@query(f"""
WITH {_LINES}, tagged AS (SELECT *, CASE WHEN {_HEADING} THEN line END AS h FROM lines),
filled AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM tagged)
SELECT doc_id, section, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM filled WHERE h IS NULL GROUP BY ALL""")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by the capital heading above them."""
    s = checks.assign_sections(document_lines(spark, sf_dir), "doc_id", F.col("line").rlike(r"^[A-Z][A-Z &,]{5,60}$"))
    return s.groupBy("doc_id", "section").agg(count().alias("lines"), F.sum(F.length("line")).alias("chars"))


_NEWS = "source IN ('euro_newswire', 'london_wire', 'sydney_feed')"


@query(f"""
WITH RECURSIVE news AS (SELECT disclosure_seq, ticker, ingested_at, title, {_ARTICLE} AS link, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM disclosures WHERE {_NEWS} AND url IS NOT NULL),
o AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'), ' ') AS tkey, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN domain = 'intel.com' OR ends_with(domain, '.intel.com') THEN 86 ELSE 50 END DESC, ingested_at DESC NULLS LAST, disclosure_seq) AS n FROM news),
walk AS (
  SELECT ticker, n, disclosure_seq, link, true AS taken, [link] AS links, [tkey] AS titles FROM o WHERE n = 1
  UNION ALL SELECT o.ticker, o.n, o.disclosure_seq, o.link, t.ok, CASE WHEN t.ok THEN list_append(w.links, o.link) ELSE w.links END, CASE WHEN t.ok THEN list_append(w.titles, o.tkey) ELSE w.titles END
  FROM walk w JOIN o ON o.ticker IS NOT DISTINCT FROM w.ticker AND o.n = w.n + 1, LATERAL (SELECT len(w.links) < 10 AND NOT list_contains(w.links, o.link) AND NOT (o.tkey <> '' AND list_contains(w.titles, o.tkey)) AS ok) t WHERE len(w.links) < 10
) SELECT ticker, disclosure_seq, link, row_number() OVER (PARTITION BY ticker ORDER BY n)::INT AS picked FROM walk WHERE taken""")
def picked_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten wire articles of each company, the best sources and the latest first, without repeated links or titles."""
    d = table(spark, sf_dir, "disclosures").where(F.col("source").isin("euro_newswire", "london_wire", "sydney_feed") & F.col("url").isNotNull()).select("disclosure_seq", "ticker", "ingested_at", "title", "url")
    order = [-articles.domain_score(urls.host(F.col("url"))), -F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62))), F.col("disclosure_seq")]
    return articles.pick(d, ["ticker"], order, 10).select("ticker", "disclosure_seq", "link", "picked")


_CLOCK = "TIMESTAMPTZ '2025-06-01 00:00:00+00'"
_SEEN = f"""
found AS (SELECT * FROM (SELECT disclosure_seq, ticker, title, url, ingested_at, {_ARTICLE} AS link FROM disclosures WHERE url IS NOT NULL AND title <> '' AND trim(title, ' ') <> '' AND ingested_at BETWEEN {_CLOCK} - INTERVAL 2400 HOUR AND {_CLOCK}) WHERE starts_with(link, 'https://')),
firsts AS (SELECT *, regexp_replace(regexp_extract(link, '^https://([^/?#]*)', 1), '^www\\.', '') AS domain FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY disclosure_seq) AS rn FROM found) WHERE rn = 1)"""


def found_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "disclosures").select("disclosure_seq", "ticker", "title", "url", "ingested_at")
    return articles.discovered(d, "url", "title", "ingested_at", F.lit("2025-06-01 00:00:00+00").cast("timestamp"), [F.col("disclosure_seq")], 2400)


@query(f"WITH {_SEEN} SELECT disclosure_seq, link, domain FROM firsts")
def discovered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of a hundred days found, the first of each link."""
    return found_articles(spark, sf_dir).select("disclosure_seq", "link", "domain")


@query(f"""
WITH {_SEEN}, raw AS (SELECT disclosure_seq AS item_seq, ticker AS t, {_ARTICLE} AS link, trim(coalesce(title, ''), ' ') AS headline, coalesce(quarter, '') AS fact, repeat(coalesce(title, '') || ' ', 1 + (disclosure_seq % 9)::INT) AS summary FROM disclosures WHERE url IS NOT NULL)
SELECT * FROM (SELECT r.item_seq, r.t AS ticker, f.disclosure_seq, f.domain AS source_name, strftime(f.ingested_at::TIMESTAMP, '%Y/%m/%d') AS article_date, row_number() OVER (PARTITION BY r.t ORDER BY r.item_seq)::INT AS item
  FROM raw r JOIN firsts f ON f.link = r.link WHERE headline <> '' AND fact <> '' AND trim(summary, ' ') <> '' AND length(trim(summary, ' ')) <= 300) WHERE item <= 10""")
def validated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a briefing that lead to an article that was found, have all their texts and a short summary."""
    d = table(spark, sf_dir, "disclosures").where("url IS NOT NULL")
    items = d.select(F.col("disclosure_seq").alias("item_seq"), "ticker", "url", F.col("title").alias("headline"), F.col("quarter").alias("fact"), F.repeat(F.concat(F.coalesce("title", F.lit("")), F.lit(" ")), F.lit(1) + (F.col("disclosure_seq") % 9).cast("int")).alias("summary"))
    known = found_articles(spark, sf_dir).select("link", "disclosure_seq", F.col("ingested_at").alias("effective_at"), articles.source_name(F.col("domain")).alias("source_name"))
    got = articles.validated(items, known, F.lit("2025-06-01 00:00:00+00").cast("timestamp"), [F.col("item_seq")], ["ticker"], 10, 2400)
    return got.join(known.select("link", "disclosure_seq"), "link").select("item_seq", "ticker", "disclosure_seq", "source_name", F.date_format("effective_at", "yyyy/MM/dd").alias("article_date"), "item")


@query("""
WITH d AS (SELECT disclosure_seq, (['', 'www.', 'WWW.', 'm.'])[1 + disclosure_seq % 4] || (['reuters.com', 'bloomberg.com', 'ft.com', 'wsj.com', 'apnews.com', 'cnbc.com', 'nikkei.com', 'asia.nikkei.com', 'federalreserve.gov', 'sec.gov', 'ecb.europa.eu', 'boj.or.jp', 'mof.go.jp', 'nvidia.com', 'tsmc.com', 'intel.com', 'notreuters.com', 'x.example'])[1 + disclosure_seq % 18] AS domain FROM disclosures)
SELECT domain, count(*) AS articles, any_value(CASE disclosure_seq % 18 WHEN 0 THEN 100 WHEN 1 THEN 98 WHEN 2 THEN 96 WHEN 3 THEN 95 WHEN 4 THEN 94 WHEN 5 THEN 92 WHEN 6 THEN 90 WHEN 7 THEN 90 WHEN 16 THEN 50 WHEN 17 THEN 50 WHEN 13 THEN 86 WHEN 14 THEN 86 WHEN 15 THEN 86 ELSE 88 END) AS score,
  any_value(CASE disclosure_seq % 18 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'Bloomberg' WHEN 2 THEN 'Financial Times' WHEN 3 THEN 'Wall Street Journal' WHEN 4 THEN 'AP' WHEN 5 THEN 'CNBC' WHEN 6 THEN 'Nikkei' WHEN 7 THEN 'Nikkei' WHEN 8 THEN 'Federal Reserve' WHEN 9 THEN 'SEC' WHEN 10 THEN 'ECB'
    WHEN 11 THEN '日本銀行' WHEN 12 THEN '日本財務省' WHEN 13 THEN 'NVIDIA' WHEN 14 THEN 'TSMC' WHEN 15 THEN 'Intel' ELSE domain END) AS name FROM d GROUP BY 1""")
def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and names of news domains; what is listed first holds for domains below it."""
    prefixes, names = ["", "www.", "WWW.", "m."], [*articles.DOMAIN_SCORES, "notreuters.com", "x.example"]
    n = F.col("disclosure_seq")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    d = table(spark, sf_dir, "disclosures").select(F.concat(at(prefixes), at(names)).alias("domain"))
    return d.groupBy("domain").agg(count().alias("articles")).select("domain", "articles", articles.domain_score(F.col("domain")).alias("score"), articles.source_name(F.col("domain")).alias("name"))


@query("""
SELECT concept, unit, count(*) AS facts, count(DISTINCT evidence_id) AS documents FROM (SELECT evidence_id, unnest(structured_facts, recursive := true) FROM evidence)
WHERE regexp_matches(lower(concept), 'revenue|income|profit|cash|margin') GROUP BY ALL""")
def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of known concepts by concept and unit."""
    f = table(spark, sf_dir, "evidence").select("evidence_id", F.inline("structured_facts")).where(F.lower("concept").rlike("revenue|income|profit|cash|margin"))
    return f.groupBy("concept", "unit").agg(count().alias("facts"), F.count_distinct("evidence_id").alias("documents"))


_META = ", ".join(f"coalesce(metadata.{c}::VARCHAR, '')" for c in ("source", "document_kind", "raw_chars", "extracted_chars", "truncated", "selection_mode", "retrieval_excerpt", "provenance", "qualitative_only"))
_FACT = ", ".join(f"coalesce(x.{c}, '')" for c in ("concept", "value", "context", "unit", "scale", "source_file"))
_SUMS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(f"""
WITH d AS (SELECT metadata.source AS source, sha256(concat_ws(chr(1), document_key, coalesce(title, ''), coalesce(url, ''), sha256(coalesce(text, '')), coalesce(array_to_string(list_transform(structured_facts, lambda x: concat_ws(chr(2), {_FACT})), chr(3)), ''), concat_ws(chr(2), {_META}))) AS h FROM evidence)
SELECT source, count(*) AS documents, sha256(concat_ws(',', count(*)::VARCHAR, {_SUMS})) AS fingerprint FROM d GROUP BY 1""")
def evidence_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each source's evidence that doesn't depend on order."""
    return store.fingerprint(table(spark, sf_dir, "evidence").withColumn("source", F.col("metadata.source")), ["source"])


@query(f"""
WITH {_PERIODS}, s AS (SELECT ticker, arg_min(title, disclosure_seq) FILTER (WHERE title <> '') AS title, arg_min(period_end, disclosure_seq) FILTER (WHERE period_end <> '') AS period_end, count(*) AS parts FROM inferred WHERE ticker IS NOT NULL GROUP BY ticker),
l AS (SELECT ticker, string_agg(source, ',' ORDER BY s) AS sources FROM (SELECT ticker, source, min(disclosure_seq) AS s FROM disclosures WHERE ticker IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT s.*, l.sources FROM s JOIN l USING (ticker)""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each company's disclosures, the first title and period that isn't empty, and its distinct sources in the order in which they first came."""
    d = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL").withColumn("sources", F.array("source"))
    m = store.merge_parts(d, "ticker", "disclosure_seq", ["sources"], ["title", "period_end"])
    return m.join(d.groupBy("ticker").agg(count().alias("parts")), "ticker").withColumn("sources", F.array_join("sources", ","))


def utf16(c: Column) -> Column:
    return text.utf16_units(c)


@query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS utf16_units, length(text) > 4000 AS cut FROM documents WHERE text IS NOT NULL")
def message_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in UTF-16 units, as message limits count them, and whether 4,000 characters cut them."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", utf16(t).alias("utf16_units"), text.shortened(t, 4000)[1].alias("cut"))


_CONTEXT = "title || ' ' || coalesce(left(published_at, 10), '')"
_NEAR = """coalesce(try_cast(nullif(regexp_replace(regexp_extract(context, '(20\\d{2}[./年-]\\d{1,2}[./月-]\\d{1,2})', 1), '[./年月]', '-', 'g'), '') AS DATE), try_strptime(nullif(regexp_extract(context, '(20\\d{6})', 1), ''), '%Y%m%d')::DATE,
    try_strptime(nullif(regexp_extract(context, '(\\d{1,2}/\\d{1,2}/\\d{2})', 1), ''), '%m/%d/%y')::DATE)"""
_MATCHED = f"""
e AS (SELECT DISTINCT event_id, ticker, fiscal_year, quarter FROM earnings_events),
once AS (SELECT ticker, fiscal_year, quarter, min(event_id) AS event_id FROM e GROUP BY ALL HAVING count(DISTINCT event_id) = 1), sole AS (SELECT ticker, min(event_id) AS event_id FROM e GROUP BY ALL HAVING count(DISTINCT event_id) = 1),
read AS (SELECT *, try_cast(nullif(regexp_extract(context, '(20\\d{{2}})', 1), '') AS INT) AS y, coalesce({_QDIGIT.replace(_FOLDED, "lower(context)")}, {_QWORD.replace(_FOLDED, "lower(context)")}) AS qd, {_NEAR} AS near, ({_KIND.replace("title", "context")}) AS kind FROM contexts),
matched AS (SELECT r.id, coalesce(o.event_id, CASE WHEN abs(day - near) <= CASE WHEN kind IN ('qa', 'transcript', 'presentation', 'supplement', 'financial_tables', 'performance_review', 'prepared_remarks') THEN 14
    WHEN {_any("lower(context)", ["earnings", "financial results", "quarterly results", "conference call", "webcast"])} THEN 7 END THEN u.event_id END) AS event_id
  FROM read r LEFT JOIN once o ON o.ticker = r.ticker AND o.fiscal_year = r.y AND o.quarter = 'Q' || coalesce(qd, CASE WHEN y IS NOT NULL AND {_any("lower(context)", ["annual", "full year", "year ended", "通期"])} THEN '4' END) LEFT JOIN sole u ON u.ticker = r.ticker)"""


@query(f"""
WITH contexts AS (SELECT disclosure_seq AS id, ticker, {_CONTEXT} AS context, ingested_at::TIMESTAMP::DATE AS day FROM disclosures WHERE ticker IS NOT NULL), {_MATCHED}
SELECT id AS disclosure_seq, event_id FROM matched WHERE event_id IS NOT NULL""")
def titles_on_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title and date alone fit one event of their company."""
    context = F.concat("title", F.lit(" "), F.coalesce(F.substring("published_at", 1, 10), F.lit("")))
    d = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL").select("disclosure_seq", "ticker", context.alias("context"), F.to_date("ingested_at").alias("day"))
    return evidence.match_events(d, table(spark, sf_dir, "earnings_events"), "disclosure_seq", "ticker", "context", "day")


@query("""
SELECT evidence_id, floor(48000 / greatest(1, n))::INT AS share, least(length(text), floor(48000 / greatest(1, n)))::INT AS kept FROM (SELECT *, count(*) OVER (PARTITION BY metadata.source) AS n FROM evidence) WHERE text IS NOT NULL""")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to equal shares of their source's budget."""
    e = table(spark, sf_dir, "evidence").select("evidence_id", F.col("metadata.source").alias("source"), "text")
    n = e.groupBy("source").agg(count().alias("n"))
    cut = evidence.equal_share(e, ["source"], "text").where("text IS NOT NULL").join(n, "source")
    return cut.select("evidence_id", F.floor(F.lit(48000) / F.greatest(F.lit(1), F.col("n"))).cast("int").alias("share"), F.length("text").alias("kept"))


@query(f"""
WITH RECURSIVE {_UNITS}, u AS (SELECT *, nullif(regexp_extract(unit, '(backlog|gross margin|free cash flow|inventory|guidance)', 1), '') AS phrase FROM named_units)
SELECT a.unit_id, a.phrase, coalesce((SELECT string_agg(b.unit_id, ',' ORDER BY b.position) FROM named_units b WHERE b.evidence_id = a.evidence_id AND b.unit_id <> a.unit_id AND contains(lower(b.unit), a.phrase)), '') AS related FROM u a WHERE a.phrase IS NOT NULL""")
def related_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other units of a document that speak of what a unit speaks of first."""
    u = stored(evidence_units(spark, sf_dir).where("position > 0"), "units")
    got = evidence.related_units(u, "evidence_id", F.nullif(F.regexp_extract("unit", r"(backlog|gross margin|free cash flow|inventory|guidance)", 1), F.lit("")))
    return got.withColumn("related", F.array_join("related", ","))


@query(f"""
WITH RECURSIVE {_SECTIONS}, b AS (SELECT *, 10000 - coalesce(sum(n_chars) OVER (PARTITION BY evidence_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM sections)
SELECT section_id, evidence_id, least(n_chars, room)::INT AS kept FROM b WHERE room > 0""")
def budgeted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of texts within 10,000 characters a text."""
    s = unitize.sections(table(spark, sf_dir, "evidence"))
    return evidence.within_budget(s, ["evidence_id"], [F.col("position")], "section", 10_000).select("section_id", "evidence_id", F.length("section").alias("kept"))


_FILED = ["revenue", "net sales", "gross margin", "operating margin", "operating income", "guidance", "outlook", "free cash flow", "cash flow", "capital expenditure", "capex", "orders", "backlog", "demand", "pricing",
    "customer", "usage", "consumption", "adoption", "capacity", "utilization", "shipment", "inventory", "competition", "market share", "segment", "risk factor", "liquidity", "working capital"]


@query(rf"""
WITH d AS (SELECT doc_id, unnest({_PARTS}) AS p FROM documents WHERE document_kind = 'filing')
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE kept) AS kept, coalesce(sum(length(p)) FILTER (WHERE kept), 0)::BIGINT AS chars FROM (
  SELECT *, {_any("lower(p)", _FILED)} OR (regexp_matches(p, '(^|{_EDGE}|\$)\d') AND {_any("lower(p)", ["revenue", "income", "margin", "cash", "segment"])}) AS kept FROM d) GROUP BY 1""")
def filing_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each filing bears on operations, by paragraphs."""
    d = table(spark, sf_dir, "documents").where("document_kind = 'filing'").select("doc_id", F.explode(text.paragraphs(F.col("text"))).alias("p"))
    kept = text.filing_paragraph_kept(F.col("p"))
    return d.groupBy("doc_id").agg(count().alias("paragraphs"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(kept, F.length("p"))), F.lit(0)).alias("chars"))


@query(rf"SELECT doc_id, len({_SENTENCES})::INT AS sentences, list_aggregate(list_transform({_SENTENCES}, lambda x: length(x)), 'max')::INT AS longest FROM (SELECT doc_id, text AS c FROM documents WHERE text IS NOT NULL)")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents and the longest of them."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query("""
WITH n AS (SELECT disclosure_seq AS id, (disclosure_seq % 23)::INT AS n, (disclosure_seq % 7)::INT AS slots FROM disclosures)
SELECT id, array_to_string(CASE WHEN slots = 0 THEN [] WHEN n <= slots THEN range(0, n) WHEN slots = 1 THEN [n - 1] ELSE list_sort(list_distinct(list_transform(range(0, slots), lambda i: round_even(i * (n - 1) / (slots - 1), 0)::BIGINT))) END, ',') AS even,
  array_to_string(CASE WHEN n <= 6 THEN range(0, n) ELSE list_sort(list_distinct([0, 1, n // 3, n // 2, n * 2 // 3, n - 2, n - 1])) END, ',') AS places FROM n""")
def sampled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that samples of lists of some lengths take: spread evenly over slots, and at the beginning, thirds, middle and end."""
    d = table(spark, sf_dir, "disclosures").select(F.col("disclosure_seq").alias("id"), (F.col("disclosure_seq") % 23).cast("int").alias("n"), (F.col("disclosure_seq") % 7).cast("int").alias("slots"))
    even = F.lit(None).cast("array<int>")
    for k in range(7):
        even = F.when(F.col("slots") == k, unitize.even_sample(F.col("n"), k)).otherwise(even)
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return d.select("id", joined(even).alias("even"), joined(evidence.positions_sample(F.col("n"))).alias("places"))
