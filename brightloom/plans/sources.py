"""Queries of the sources' parsers, and the SQL that says the same.

The tables hold no pages, indexes or payloads. Each query writes them from a table, as the source would deliver them, and reads them with the parser;
the SQL says from the same table what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import periods, text, urls
from brightloom.operators import evidence, pages, store
from brightloom.plans.documents import _MATCHED, _WS, _any
from brightloom.session import stored, table
from brightloom.sources import filings, markup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _squeezed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' ')"


# ---- filing indexes


def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of a company's forms a year, as parallel arrays."""
    d = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL AND metadata.form IS NOT NULL AND ingested_at IS NOT NULL")
    n = F.col("disclosure_seq")
    row = F.struct(
        n, F.coalesce("source_id", F.lit("")).alias("accessionNumber"), F.to_date("ingested_at").cast("string").alias("filingDate"), F.coalesce("period_end", F.lit("")).alias("reportDate"), F.when(n % 2 == 0, F.concat(F.to_date("ingested_at").cast("string"), F.lit("T16:05:00.000Z"))).otherwise("").alias("acceptanceDateTime"),
        F.when(n % 10 == 0, "6-K").otherwise(F.col("metadata.form")).alias("form"), _join("d", n, ".htm").alias("primaryDocument"), F.when(n % 3 == 0, "").otherwise(F.col("title")).alias("primaryDocDescription"), F.when(n % 4 == 0, "8.01").when(n % 4 == 1, "7.01").otherwise("2.02,9.01").alias("items"),
    )
    one = d.groupBy("ticker", F.year("ingested_at").alias("y")).agg(F.array_sort(F.collect_list(row)).alias("r"))  # a company's forms of a year
    arrays = F.struct(*[F.col("r")[c].alias(c) for c in ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument", "primaryDocDescription")], F.slice(F.col("r")["items"], 1, F.greatest(F.lit(0), F.size("r") - 1)).alias("items"))
    return one.select(F.concat_ws("/", "ticker", "y").alias("cik"), F.lit("0930").alias("fiscalYearEnd"), F.struct(arrays.alias("recent")).alias("filings"))


_INDEX = """
d AS (SELECT *, ingested_at::TIMESTAMP::DATE::VARCHAR AS day, ticker || '/' || year(ingested_at::TIMESTAMP) AS cik, CASE WHEN disclosure_seq % 10 = 0 THEN '6-K' ELSE metadata.form END AS form FROM disclosures WHERE ticker IS NOT NULL AND metadata.form IS NOT NULL AND ingested_at IS NOT NULL),
records AS (
  SELECT cik, (row_number() OVER w - 1)::INT AS seq, coalesce(source_id, '') AS accession, day, coalesce(period_end, '') AS report, CASE WHEN disclosure_seq % 2 = 0 THEN day || 'T16:05:00.000Z' ELSE '' END AS accepted, form, 'd' || disclosure_seq || '.htm' AS document,
    CASE WHEN disclosure_seq % 3 = 0 THEN '' ELSE coalesce(title, '') END AS description, CASE WHEN lead(1) OVER w IS NULL THEN '' WHEN disclosure_seq % 4 = 0 THEN '8.01' WHEN disclosure_seq % 4 = 1 THEN '7.01' ELSE '2.02,9.01' END AS items, disclosure_seq
  FROM d WINDOW w AS (PARTITION BY cik ORDER BY disclosure_seq))"""


@query(f"WITH {_INDEX} SELECT cik, seq, accession, day AS filed, report, accepted, form, document, description, items FROM records")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of filing indexes, whose last list is one shorter than the others."""
    r = filings.records(filing_index(spark, sf_dir))
    return r.select("cik", "seq", F.col("accessionNumber").alias("accession"), F.col("filingDate").alias("filed"), F.col("reportDate").alias("report"), F.col("acceptanceDateTime").alias("accepted"), "form", F.col("primaryDocument").alias("document"), F.col("primaryDocDescription").alias("description"), "items")


@query(f"WITH {_INDEX} SELECT cik, accession, form FROM records WHERE day BETWEEN '2025-05-29' AND '2025-06-30' AND (form IN ('10-Q', '10-K') OR form = '6-K' OR (form = '8-K' AND (contains(items, '2.02') OR contains(items, '7.01'))))")
def filings_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of a month of the forms and items that tell results."""
    return filings.in_window(filings.records(filing_index(spark, sf_dir)), "2025-06-30", 32).select("cik", F.col("accessionNumber").alias("accession"), "form")


_PERIODS_OF_FORMS = """
dated AS (SELECT *, CASE WHEN report = '' THEN NULL ELSE (substr(report, 6, 2)::INT - 9 + 12) % 12 END AS far FROM records),
said AS (SELECT *, CASE WHEN far IN (0, 1, 11) THEN 'Q4' WHEN far <= 4 THEN 'Q1' WHEN far <= 7 THEN 'Q2' WHEN far <= 10 THEN 'Q3' END AS by_month,
  (SELECT max(a.report) FROM records a WHERE a.cik = d.cik AND a.form = '10-K' AND a.report < d.report) AS last_annual FROM dated d),
own AS (SELECT *, CASE WHEN form = '10-K' THEN 'Q4' WHEN form = '10-Q' THEN CASE WHEN by_month IS NOT NULL AND by_month <> 'Q4' THEN by_month ELSE 'Q' || least(3, greatest(1, (SELECT count(DISTINCT q.report) FROM records q WHERE q.cik = s.cik AND q.form = '10-Q' AND q.report > coalesce(s.last_annual, '') AND q.report <= s.report))) END
  ELSE (SELECT CASE WHEN n <> '' THEN 'Q' || n WHEN w <> '' THEN 'Q' || w WHEN regexp_matches(s.description, '20\\d{2}') AND regexp_matches(lower(s.description), 'annual|full year|year ended|通期') THEN 'Q4' END FROM (SELECT regexp_extract(lower(s.description), '(?:q([1-4])|([1-4])q|([1-4])(?:st|nd|rd|th)\\s+quarter|第?([1-4])四半期)', 0) AS t,
    regexp_extract(t, '[1-4]', 0) AS n, CASE regexp_extract(lower(s.description), '\\b(first|second|third|fourth)\\s+quarter\\b', 1) WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' WHEN 'fourth' THEN '4' ELSE '' END AS w)) END AS quarter FROM said s),
near AS (SELECT c.cik, c.seq, arg_min({'r': p.report, 'q': p.quarter}, abs(p.day::DATE - c.day::DATE) * 1000000 + p.seq) AS p FROM own c JOIN own p ON p.cik = c.cik AND p.form IN ('10-Q', '10-K') AND p.report <> '' AND abs(p.day::DATE - c.day::DATE) <= 3 WHERE c.form IN ('8-K', '6-K') GROUP BY ALL),
placed AS (SELECT o.* EXCLUDE (report, quarter), coalesce(n.p.r, o.report) AS report, coalesce(n.p.q, o.quarter) AS quarter FROM own o LEFT JOIN near n ON n.cik = o.cik AND n.seq = o.seq),
forms AS (SELECT *, CASE WHEN report <> '' THEN (substr(report, 1, 4)::INT + (substr(report, 6, 2) || substr(report, 9, 2) > '0930')::INT) END AS fiscal_year FROM placed)"""


def placed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.with_related_period(filings.with_report_period(filings.records(filing_index(spark, sf_dir))))


@query(f"WITH {_INDEX}, {_PERIODS_OF_FORMS} SELECT cik, seq, form, nullif(report, '') AS report, quarter, fiscal_year::INT AS fiscal_year FROM forms")
def filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter and year of each filing: by its month, by counting, or of the periodic report nearby."""
    return placed_records(spark, sf_dir).select("cik", "seq", "form", F.nullif("reportDate", F.lit("")).alias("report"), "quarter", "fiscal_year")


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of files of each current filing: its form, an exhibit, a picture and a data file."""
    r = filings.records(filing_index(spark, sf_dir)).where("form IN ('8-K', '6-K')").withColumn("n", F.regexp_extract("primaryDocument", r"\d+", 0).cast("long"))
    day = F.date_sub(F.col("filingDate").cast("date"), 40)
    named = F.when(F.col("n") % 3 == 0, _join("release-", F.date_format(day, "yyyyMMdd"), "ex991.htm")).when(F.col("n") % 3 == 1, _join("deck_q", F.col("n") % 4 + 1, "-fy27.htm")).otherwise(_join("ex", F.col("n"), ".htm"))
    row = lambda k, description, link, kind: _join("<tr><td>", F.lit(k), "</td><td>", description, "</td><td><a href='", link, "'>file</a></td><td>", kind, "</td></tr>")
    html = _join("<html><body><table class='tableFile'><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr>", row("1", F.col("form"), F.col("primaryDocument"), F.col("form")), row("2", F.when(F.col("n") % 2 == 0, "Earnings Release").otherwise(""), named, F.lit("ex-99.1")),
        row("3", F.lit("logo"), F.lit("logo.jpg"), F.lit("GRAPHIC")), row("4", F.lit("Consent"), F.lit("ex23.htm"), F.lit("EX-23.1")), "</table><table><tr><td>a</td><td>b</td><td><a href='other.htm'>c</a></td><td>d</td></tr></table></body></html>")
    return r.select("cik", "n", "accessionNumber", F.col("primaryDocument").alias("page_id"), _join("https://files.example/", F.col("accessionNumber"), "/index.html").alias("url"), html.alias("html"))


_FILES = """
base AS (SELECT *, disclosure_seq AS n, CASE disclosure_seq % 3 WHEN 0 THEN 'release-' || strftime(day::DATE - 40, '%Y%m%d') || 'ex991.htm' WHEN 1 THEN 'deck_q' || (disclosure_seq % 4 + 1) || '-fy27.htm' ELSE 'ex' || disclosure_seq || '.htm' END AS exhibit FROM records WHERE form IN ('8-K', '6-K')),
files AS (SELECT document, accession, form AS description, form AS document_type, document AS file FROM base UNION ALL SELECT document, accession, CASE WHEN n % 2 = 0 THEN 'Earnings Release' ELSE 'EX-99.1' END, 'EX-99.1', exhibit FROM base UNION ALL SELECT document, accession, 'Consent', 'EX-23.1', 'ex23.htm' FROM base)"""


@query(f"WITH {_INDEX}, {_FILES} SELECT document AS page, description, document_type, 'https://files.example/' || accession || '/' || file AS url FROM files")
def attachment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of filings as their pages list them, without pictures."""
    return markup.attachment_rows(index_pages(spark, sf_dir)).withColumnRenamed("page_id", "page")


@query(rf"""
WITH {_INDEX}, {_PERIODS_OF_FORMS}, {_FILES},
all_files AS (
  SELECT f.*, CASE WHEN f.description <> '' THEN f.description ELSE 'Form ' || f.form END AS shown, f.form AS document_type, 'https://www.sec.gov/Archives/edgar/data/' || f.disclosure_seq || '/' || replace(f.accession, '-', '') || '/' || f.document AS url, f.document AS file FROM forms f WHERE form IN ('10-Q', '10-K')
  UNION ALL SELECT f.*, x.description, x.document_type, 'https://files.example/' || f.accession || '/' || x.file, x.file FROM forms f JOIN files x ON x.document = f.document WHERE f.form IN ('8-K', '6-K') AND x.document_type IN (f.form, 'EX-99.1')
    AND (f.form <> '6-K' OR x.document_type = f.form OR regexp_matches(lower(x.description || ' ' || f.description || ' ' || x.file), 'earnings|financial results|quarterly results|annual results|shareholder letter|investor presentation|results presentation|press release'))),
read AS (SELECT *, document_type = 'EX-99.1' AS ex, CASE WHEN document_type = 'EX-99.1' AND starts_with(file, 'release-') THEN day::DATE - 40 END AS dated, CASE WHEN starts_with(file, 'deck_q') THEN file[7] END AS fq FROM all_files),
titled AS (SELECT *, 'Name ' || disclosure_seq || ' Form ' || form || ' — ' || CASE WHEN ex AND form IN ('8-K', '6-K') THEN 'Earnings Release / Exhibit EX-99.1 — ' || CASE WHEN fq IS NOT NULL OR dated IS NOT NULL THEN file ELSE shown END ELSE shown END AS title FROM read)
SELECT accession || ':' || file AS source_id, title, coalesce(nullif(accepted, ''), day || 'T00:00:00-04:00') AS published_at, url,
  coalesce(CASE WHEN fq IS NOT NULL THEN 2027 END, (year(dated) + (strftime(dated, '%m%d') > '0930')::INT)::INT, fiscal_year, try_cast(nullif(regexp_extract(title, '(20\d{{2}})', 1), '') AS INT))::INT AS fiscal_year,
  coalesce('Q' || fq, CASE WHEN dated IS NOT NULL THEN CASE WHEN (month(dated) - 9 + 12) % 12 IN (0, 1, 11) THEN 'Q4' WHEN (month(dated) - 9 + 12) % 12 <= 4 THEN 'Q1' WHEN (month(dated) - 9 + 12) % 12 <= 7 THEN 'Q2' ELSE 'Q3' END END, quarter,
    'Q' || nullif(regexp_extract(regexp_extract(lower(title), 'q[1-4]|[1-4]q|[1-4](?:st|nd|rd|th)\s+quarter', 0), '[1-4]', 0), ''), CASE regexp_extract(lower(title), '\b(first|second|third|fourth)\s+quarter\b', 1) WHEN 'first' THEN 'Q1' WHEN 'second' THEN 'Q2' WHEN 'third' THEN 'Q3' WHEN 'fourth' THEN 'Q4' END,
    CASE WHEN regexp_matches(title, '20\d{{2}}') AND regexp_matches(lower(title), 'annual|full year|year ended') THEN 'Q4' END) AS quarter, coalesce(dated::VARCHAR, nullif(report, '')) AS period_end, form, document_type FROM titled""")
def filed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as disclosures: primary documents and exhibits, each with the period that is best known."""
    r = placed_records(spark, sf_dir).withColumn("_n", F.regexp_extract("primaryDocument", r"\d+", 0))
    p = index_pages(spark, sf_dir)
    files = markup.attachment_rows(p).join(p.select("page_id", "accessionNumber"), "page_id").select(F.concat_ws("|", "accessionNumber", "page_id").alias("accessionNumber"), "description", "document_type", "url")
    # a document delivered twice has one accession number: records and companies are told apart by the primary document
    rows = r.withColumn("accessionNumber", F.concat_ws("|", "accessionNumber", "primaryDocument")).withColumn("cik", F.col("_n"))
    d = filings.documents_of(rows, files, r.select(F.col("_n").alias("cik"), F.lit("T").alias("ticker"), _join("Name ", F.col("_n")).alias("name")))
    plain = lambda c: F.regexp_replace(c, r"\|d\d+\.htm", "")
    return d.select(plain("source_id").alias("source_id"), "title", "published_at", plain("url").alias("url"), "fiscal_year", "quarter", "period_end", "form", "document_type")


# ---- pages of companies


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ticker, day, url, html): a page of a company's events a day, and a page of each of its documents that links to the document itself."""
    c = table(spark, sf_dir, "companies").where("ir_index_url IS NOT NULL").select("ticker", "ir_index_url")
    d = table(spark, sf_dir, "disclosures").where("title IS NOT NULL AND url IS NOT NULL AND ingested_at IS NOT NULL").join(F.broadcast(c), "ticker").withColumn("day", F.to_date("ingested_at"))
    mark = lambda u, label, rest: _join("<li><a href=\"", text.escape_html(u), "\">", text.escape_html(label), "</a>", rest, "</li>")
    item = mark(F.col("url"), F.col("title"), _join(" ", F.coalesce(F.substring("published_at", 1, 10), F.lit(""))))
    index = d.groupBy("ticker", "day", "ir_index_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("disclosure_seq", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"))
    index = index.select(_join("index ", F.col("ticker"), " ", F.col("day")).alias("page_id"), "ticker", "day", _join(F.col("ir_index_url"), F.col("day")).alias("url"), _join("<html><body><h1>Events</h1><ul>", F.col("items"), "</ul><script>var x = \"https:\\/\\/cdn.", F.lower("ticker"), ".example\\/earnings.pdf\";</script></body></html>").alias("html"))
    own = d.where("document_url IS NOT NULL").select(_join("document ", F.col("disclosure_seq")).alias("page_id"), "ticker", "day", F.col("url"), _join("<html><body><h1>", text.escape_html(F.col("title")), "</h1><p>Get it ", "<a href='", F.col("document_url"), "'>as presentation</a></p></body></html>").alias("html"))
    return index.unionByName(own)


_BASE = """
c AS (SELECT * FROM companies WHERE ir_index_url IS NOT NULL), d AS (SELECT d.*, c.ir_index_url, c.official_domains, c.ir_additional_urls, ingested_at::TIMESTAMP::DATE AS day FROM disclosures d JOIN c USING (ticker) WHERE title IS NOT NULL AND url IS NOT NULL AND ingested_at IS NOT NULL)"""
_LINKS = rf"""
{_BASE}, raw AS (
  SELECT 'index ' || ticker || ' ' || day AS page_id, ticker, day, disclosure_seq AS n, url AS target, {_squeezed("title")} AS label, {_squeezed("title")} || ' Events' || CASE WHEN coalesce(left(published_at, 10), '') = '' OR trim(left(published_at, 10), ' ') = '' THEN '' ELSE ' ' || {_squeezed("title || ' ' || left(published_at, 10)")} END AS context, 'Events' AS headline, official_domains, ir_index_url, ir_additional_urls FROM d
  UNION ALL SELECT 'document ' || disclosure_seq, ticker, day, 0, document_url, 'as presentation', 'as presentation ' || {_squeezed("title")} || ' Get it as presentation', {_squeezed("title")}, official_domains, ir_index_url, ir_additional_urls FROM d WHERE document_url IS NOT NULL),
hosted AS (SELECT *, regexp_extract(target, '^https?://([^/?#]*)', 1) AS host, list_concat(list_transform(list_concat([ir_index_url], coalesce(ir_additional_urls, [])), lambda u: regexp_extract(u, '^https?://([^/?#]*)', 1)), coalesce(official_domains, [])) AS hosts FROM raw),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY n) AS rn FROM hosted WHERE list_aggregate(list_transform(hosts, lambda a: a <> '' AND (host = a OR ends_with(host, '.' || a))), 'bool_or')
  AND {_any("lower(context)", ["決算", "業績", "説明", "質疑", "qa", "q&a", "transcript", "financial results", "earnings", "presentation", "supplement", "briefing", "fact book", "quarterly", "quarter", "investor relations", "shareholder", "financial tables", "performance review", "prepared remarks", "webcast", "conference call"])}) WHERE rn = 1),
contexts AS (SELECT page_id || chr(1) || n AS id, ticker, context, day FROM kept UNION ALL SELECT DISTINCT page_id, ticker, headline, day FROM kept), {_MATCHED},
found AS (SELECT k.*, coalesce(a.event_id, b.event_id) AS event_id FROM kept k LEFT JOIN matched a ON a.id = k.page_id || chr(1) || k.n LEFT JOIN matched b ON b.id = k.page_id),
typed AS (SELECT *, regexp_matches(lower(target), '\.(pdf|htm|html|xlsx|xls|txt)$') OR {_any("lower(context)", ["qa", "q&a", "transcript", "presentation", "supplement", "financial tables", "performance review", "prepared remarks", "earnings release", "press release", "financial results", "earnings", "webcast", "audio replay", "replay"])} AS is_document,
  NOT regexp_matches(lower(target), '\.pdf$') AND {_any("lower(context)", ["earnings", "financial results", "quarterly results", "results", "fiscal year", "quarter"])} AS is_event_page FROM found WHERE event_id IS NOT NULL)"""


def page_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = stored(company_pages(spark, sf_dir), "pages")
    links = markup.links(p).join(p.select("page_id", "ticker", "day"), "page_id")
    return p, pages.page_documents(links, table(spark, sf_dir, "companies"), table(spark, sf_dir, "earnings_events"))


@query(f"WITH {_LINKS} SELECT page_id, target, event_id, left(sha256(target), 24) AS source_id, is_document, is_event_page FROM typed")
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of companies' pages that lead to documents or pages of their events."""
    return page_links(spark, sf_dir)[1].select("page_id", "target", "event_id", "source_id", "is_document", "is_event_page")


@query(f"""
WITH {_LINKS}, hops AS (SELECT * FROM (SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY n, target)::INT AS hop FROM typed WHERE is_event_page AND starts_with(page_id, 'index')) WHERE hop <= 8),
at AS (SELECT url, min('document ' || disclosure_seq) AS page_to FROM d WHERE document_url IS NOT NULL GROUP BY 1),
every AS (SELECT page_id, 0 AS hop, n, target, event_id FROM typed WHERE is_document AND starts_with(page_id, 'index') UNION ALL SELECT h.page_id, h.hop, t.n, t.target, t.event_id FROM hops h JOIN at a ON a.url = h.target JOIN typed t ON t.page_id = a.page_to AND t.is_document)
SELECT page_id, hop, target, event_id, false AS missing FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY hop, n) AS rn FROM every) WHERE rn = 1
UNION ALL SELECT h.page_id, h.hop, h.target, NULL, true FROM hops h WHERE h.target NOT IN (SELECT url FROM at)""".replace("\nat AS", "\nurls AS").replace("JOIN at a", "JOIN urls a").replace("FROM at)", "FROM urls)"))
def crawled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of companies' pages and of the first eight event pages that these name."""
    p, found = page_links(spark, sf_dir)
    return pages.crawled(found, p, p.where("page_id LIKE 'index%'")).select("page_id", "hop", "target", "event_id", "missing")


@query("""
WITH a AS (SELECT ticker, disclosure_seq % 5 <> 0 AND coalesce(metadata.format, '') <> 'pdf' AS ok FROM disclosures WHERE ticker IS NOT NULL)
SELECT ticker, count(*) AS pages, count(*) FILTER (WHERE ok) AS "read", CASE WHEN bool_and(ok) THEN 'checked' WHEN bool_or(ok) THEN 'partial' ELSE 'failed' END AS status FROM a GROUP BY 1""")
def collection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all, some or none of a company's pages could be read."""
    a = table(spark, sf_dir, "disclosures").where("ticker IS NOT NULL").select("ticker", ((F.col("disclosure_seq") % 5 != 0) & (F.coalesce("metadata.format", F.lit("")) != "pdf")).alias("ok"))
    return evidence.collection_status(a, "ticker", "ok")


@query(rf"""
WITH t AS (SELECT evidence_id, string_split_regex(text, '[\n\r]+') AS ls FROM evidence WHERE text IS NOT NULL AND NOT regexp_matches(text, '[<>&]'))
SELECT evidence_id, md5(array_to_string(list_filter(list_transform(ls, lambda x: {_squeezed("x")}), lambda x: x <> ''), chr(10))) AS digest FROM t""")
def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of pages without scripts, styles, navigation, heads and feet."""
    body = F.array_join(F.transform(F.split("text", r"[\n\r]+"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n")
    html = _join("<html><head><style>p {color: red}</style><script>var a = 'x';</script></head><body><nav>menu</nav><header>top</header>", body, "<footer>imprint</footer><noscript>no</noscript><svg><text>y</text></svg></body></html>")
    p = table(spark, sf_dir, "evidence").where(F.col("text").isNotNull() & ~F.col("text").rlike("[<>&]")).select(F.col("evidence_id").alias("page_id"), html.alias("html"))
    return markup.page_text(p).select(F.col("page_id").alias("evidence_id"), F.md5("text").alias("digest"))


@query(r"""
SELECT e.evidence_id, length(text) >= 5000 AND (contains(lower(text), lower(d.ticker)) OR contains(lower(text), lower(string_split(c.name, ' ')[1]))) AND (contains(lower(text), 'earnings call transcript') OR contains(lower(text), 'conference call') OR contains(lower(text), 'results call'))
  AND regexp_matches(lower(text), 'question-and-answer|question and answer|operator|your line is open|open up the call for questions') AS verified
FROM evidence e JOIN (SELECT source || ':' || source_id AS k, min(ticker) AS ticker FROM disclosures GROUP BY 1) d ON d.k = e.document_key JOIN companies c ON c.ticker = d.ticker WHERE text IS NOT NULL""")
def verified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is its company's call; "results call" counts as a conference call here."""
    d = table(spark, sf_dir, "disclosures").groupBy(F.concat("source", F.lit(":"), "source_id").alias("document_key")).agg(F.min("ticker").alias("ticker"))
    e = table(spark, sf_dir, "evidence").where("text IS NOT NULL").join(d, "document_key").join(F.broadcast(table(spark, sf_dir, "companies").select("ticker", "name")), "ticker")
    said = F.regexp_replace("text", "(?i)results call", "conference call")
    return e.select("evidence_id", (filings.looks_like_transcript(said, F.col("ticker"), F.col("name"), 0) & (F.length("text") >= 5000)).alias("verified"))


@query(r"""
SELECT disclosure_seq, CASE disclosure_seq % 5 WHEN 0 THEN published_at WHEN 1 THEN published_at WHEN 2 THEN published_at WHEN 3 THEN published_at END AS published, nullif(trim(title, ' '), '') AS title, source AS description FROM disclosures WHERE title IS NOT NULL AND published_at <> ''""")
def page_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published time, title and description of pages: from JSON-LD as an object, in a list or in a graph, or from meta elements."""
    n, at = F.col("disclosure_seq"), F.regexp_replace("published_at", '"', "")
    said = F.to_json(F.struct(at.alias("datePublished")))
    ld = lambda body: _join('<script type="application/ld+json">', body, "</script>")
    head = F.when(n % 5 == 0, ld(said)).when(n % 5 == 1, ld(_join('[{"@type": "Thing"}, ', said, "]"))).when(n % 5 == 2, ld(_join('{"@graph": [', said, "]}"))).when(n % 5 == 3, _join("<script type='application/ld+json'>{broken</script><meta property='article:published_time' content='", text.escape_html(at), "'>")).otherwise(F.lit(""))
    html = _join("<html><head>", head, '<meta property="og:title" content="', text.escape_html(F.trim("title")), '"><meta name="description" content="', F.col("source"), '"></head><body>x</body></html>')
    p = table(spark, sf_dir, "disclosures").where("title IS NOT NULL AND published_at <> ''").select(n.alias("page_id"), html.alias("html"))
    return markup.page_metadata(p).withColumnRenamed("page_id", "disclosure_seq")


@query(rf"""
WITH f AS (SELECT evidence_id, unnest(structured_facts, recursive := true) FROM evidence)
SELECT evidence_id, concept, {_squeezed("value")} AS value, context, unit, scale FROM f WHERE {_squeezed("value")} <> '' AND regexp_matches(lower(concept), 'revenue|income|profit|earnings|cash|margin|assets|liabilities|capital|inventory|backlog|debt|tax|expense')""")
def tagged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts tagged within pages, of known concepts."""
    tag = lambda f: F.concat(F.lit("<p>It was <ix:nonFraction name=\""), f["concept"], F.lit("\" contextRef='"), F.coalesce(f["context"], F.lit("")), F.lit("' unitRef=\""), F.coalesce(f["unit"], F.lit("")), F.lit("\" scale=\""), F.coalesce(f["scale"], F.lit("")), F.lit("\"><b>"), F.coalesce(f["value"], F.lit("")), F.lit("</b></ix:nonFraction>.</p>"))
    files = table(spark, sf_dir, "evidence").where(F.size("structured_facts") > 0).select(F.col("evidence_id").alias("path"), F.encode(_join("<html><body>", F.array_join(F.transform("structured_facts", tag), "\n"), "</body></html>"), "UTF-8").alias("content"))
    blank = lambda c: F.nullif(c, F.lit(""))
    return markup.facts(files).select(F.col("path").alias("evidence_id"), "concept", "value", blank("context").alias("context"), blank("unit").alias("unit"), blank("scale").alias("scale"))


@query(r"""
WITH s AS (SELECT ticker, c.official_domains, disclosure_seq, d.url, d.title, CASE WHEN disclosure_seq % 9 = 0 THEN 'memo' ELSE document_kind END AS kind, (disclosure_seq // 3) AS answer FROM disclosures d JOIN companies c USING (ticker) WHERE d.url IS NOT NULL AND title IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY ticker, answer ORDER BY disclosure_seq) - 1 AS at_, min(disclosure_seq) OVER (PARTITION BY ticker, answer, url) AS first_seq, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM s)
SELECT ticker || ' ' || answer AS answer_id, at_::INT AS place, url AS link, title, left(sha256(url), 24) AS source_id,
  CASE WHEN kind IS NULL OR kind NOT IN ('qa', 'transcript', 'presentation', 'supplement', 'financial_tables', 'performance_review', 'prepared_remarks', 'financial_results') THEN 'unknown_kind' WHEN NOT coalesce(list_aggregate(list_transform(official_domains, lambda a: a <> '' AND (host = a OR ends_with(host, '.' || a))), 'bool_or'), false) THEN 'other_host' WHEN disclosure_seq > first_seq THEN 'repeated' END AS rejected FROM p""")
def grounded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that search models' answers name, each accepted or with the reason why not. Answers come in code fences."""
    c = table(spark, sf_dir, "companies").select("ticker", "official_domains")
    d = table(spark, sf_dir, "disclosures").where("url IS NOT NULL AND title IS NOT NULL").join(F.broadcast(c), "ticker")
    item = F.struct("disclosure_seq", F.struct("url", "title", F.when(F.col("disclosure_seq") % 9 == 0, "memo").otherwise(F.col("document_kind")).alias("document_kind"), "published_at").alias("s"))
    a = d.groupBy("ticker", F.floor(F.col("disclosure_seq") / 3).alias("n")).agg(F.array_sort(F.collect_list(item)).alias("all"), F.first("official_domains").alias("allowed"))  # three of a company at most
    a = a.select(_join(F.col("ticker"), " ", F.col("n")).alias("answer_id"), "allowed", _join("```json\n", F.to_json(F.struct(F.transform("all", lambda x: x["s"]).alias("sources"))), "\n```").alias("answer"))
    return evidence.grounded_sources(a, "answer_id", "answer", "allowed").withColumnRenamed("at", "place").drop("document_kind")


@query(rf"""
WITH t AS (SELECT document_key, card_seq, trim(coalesce(nullif(speaker, ''), analyst, ''), ' ') AS who, trim(coalesce(topic, ''), ' ') AS title, trim(coalesce(nullif(question_summary, ''), answer_summary, ''), ' ') AS said FROM cards WHERE document_key IS NOT NULL)
SELECT document_key, coalesce(trim(string_agg(CASE WHEN title <> '' AND NOT contains(lower(who), lower(title)) THEN CASE WHEN who <> '' THEN who || ' (' || title || '): ' ELSE title || ': ' END WHEN who <> '' THEN who || ': ' ELSE '' END || said, chr(10) || chr(10) ORDER BY card_seq) FILTER (WHERE said <> ''), ' '), '') AS said FROM t GROUP BY 1""")
def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of calls, as an interface delivers them, as one text."""
    turn = F.struct("card_seq", F.col("speaker"), F.col("analyst").alias("name"), F.col("topic").alias("title"), F.col("question_summary").alias("content"), F.col("answer_summary").alias("text"))
    c = table(spark, sf_dir, "cards").where("document_key IS NOT NULL").groupBy("document_key").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # the turns of one call
    return c.select("document_key", filings.transcript_text(F.col("turns")).alias("said"))


@query(r"""
WITH e AS (SELECT event_row, e.ticker, name, fiscal_year, nullif(regexp_extract(coalesce(quarter, ''), '[1-4]', 0), '') AS q, period_end FROM earnings_events e JOIN companies c USING (ticker) WHERE fiscal_year IS NOT NULL)
SELECT event_row, left(sha256(ticker || ':' || fiscal_year || ':Q' || q || ':calls'), 24) AS source_id, name || ' FY' || fiscal_year || ' Q' || q || ' Earnings Call Transcript (third-party: calls)' AS title, 'Q' || q AS quarter, fiscal_year || 'Q' || q AS call_key, period_end FROM e WHERE q IS NOT NULL""")
def call_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of events as disclosures, and the keys that an interface wants."""
    e = table(spark, sf_dir, "earnings_events").join(F.broadcast(table(spark, sf_dir, "companies").select("ticker", "name")), "ticker")
    calls = e.select(F.col("event_row").cast("string").alias("url"), "ticker", "name", "fiscal_year", "quarter", "period_end", F.lit("x").alias("said"))
    d = filings.call_documents(calls, "third_party_transcript", "calls")
    return d.select(F.col("url").cast("long").alias("event_row"), "source_id", "title", "quarter", periods.transcript_quarter(F.col("fiscal_year"), F.col("quarter")).alias("call_key"), "period_end")


# ---- small functions of sources


@query(r"""
SELECT disclosure_seq, CASE WHEN disclosure_seq % 3 = 0 THEN 'https://' || lower(regexp_extract(url, '^https?://([^/]*)', 1)) ELSE lower(regexp_extract(url, '^(https?://[^/]*)', 1)) END || regexp_extract(url, '^https?://[^/]*(.*)$', 1) || CASE WHEN disclosure_seq % 2 = 0 THEN '?v=1&utm_a=b' ELSE '' END AS link FROM disclosures WHERE url IS NOT NULL""")
def asset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form for links of assets, also with escaped slashes, without a scheme and with a fragment; their queries stay."""
    n, u = F.col("disclosure_seq"), F.col("url")
    dirty = F.when(n % 3 == 0, F.replace(F.regexp_replace(u, "^https?:", ""), F.lit("/"), F.lit("\\/"))).when(n % 3 == 1, F.concat(F.upper(F.regexp_extract(u, r"^(https?://[^/]*)", 1)), F.regexp_extract(u, r"^https?://[^/]*(.*)$", 1))).otherwise(u)
    return table(spark, sf_dir, "disclosures").where(u.isNotNull()).select("disclosure_seq", urls.asset_key(F.concat(dirty, F.when(n % 2 == 0, "?v=1&utm_a=b").otherwise(""), F.lit("#top"))).alias("link"))


@query(r"""
WITH d AS (SELECT disclosure_seq AS n, ingested_at::TIMESTAMP::DATE AS filed FROM disclosures WHERE ingested_at IS NOT NULL)
SELECT n, CASE n % 4 WHEN 0 THEN filed - 30 WHEN 1 THEN filed - 10 WHEN 2 THEN NULL ELSE filed - 120 END AS dated, CASE WHEN n % 3 = 0 THEN (2000 + n % 30)::INT END AS fiscal_year, CASE WHEN n % 3 = 0 THEN 'Q' || (n % 4 + 1) END AS quarter FROM d""")
def file_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and periods in names of exhibits: the first real date of the last 120 days, and a quarter with its year."""
    n, filed = F.col("disclosure_seq"), F.to_date("ingested_at")
    ymd = lambda days: F.date_format(F.date_sub(filed, days), "yyyyMMdd")
    name = F.when(n % 4 == 0, _join("a-", ymd(30), "ex991")).when(n % 4 == 1, _join("b20260230-", ymd(400), "_", ymd(10), "-", ymd(20))).when(n % 4 == 2, _join("c", ymd(121), "-1", ymd(3), "-", ymd(-1))).otherwise(_join(ymd(120), "x"))
    more = F.when(n % 3 == 0, F.when(n % 2 == 0, _join("_q", n % 4 + 1, "--fy20", F.lpad((n % 30).cast("string"), 2, "0"))).otherwise(_join("_", n % 4 + 1, "Q.FY", F.lpad((n % 30).cast("string"), 2, "0")))).when(n % 3 == 1, "_q5fy26").otherwise("_fy26q1")
    d = table(spark, sf_dir, "disclosures").where("ingested_at IS NOT NULL").select(n.alias("n"), filed.alias("filed"), F.concat(name, more, F.lit(".htm")).alias("name"))
    year, quarter = periods.period_in_filename(F.col("name"))
    return d.select("n", periods.date_in_filename(F.col("name"), F.col("filed")).alias("dated"), year.alias("fiscal_year"), quarter.alias("quarter"))


@query(r"""
WITH d AS (SELECT disclosure_seq AS n, ingested_at::TIMESTAMP::DATE AS at FROM disclosures WHERE ingested_at IS NOT NULL)
SELECT n, CASE WHEN n % 6 = 5 THEN NULL ELSE at END AS near FROM d""".replace(" AS at FROM", " AS day FROM").replace("ELSE at END", "ELSE day END"))
def nearby_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in texts in several forms; those that aren't real are passed over for the next form."""
    n, at = F.col("disclosure_seq"), F.to_date("ingested_at")
    f = lambda p: F.date_format(at, p)
    said = F.when(n % 6 == 0, _join("Call on ", f("yyyy-M-d"), ", later")).when(n % 6 == 1, _join("決算 ", f("yyyy年M月d日"))).when(n % 6 == 2, _join("2026-02-30 but ", f("yyyyMMdd"), " it was")).when(n % 6 == 3, _join("on ", f("M/d/yy"), " at noon")).when(n % 6 == 4, _join("as of ", f("yyyy.MM.dd"), " and 20200101")).otherwise("no date 99/99/99")
    d = table(spark, sf_dir, "disclosures").where("ingested_at IS NOT NULL").select(n.alias("n"), said.alias("said"))
    return d.select("n", periods.nearby_date(F.col("said")).alias("near"))


@query(r"""
SELECT event_row, (epoch(TIMESTAMPTZ '2027-01-01 00:00:00+00') - epoch(updated_at))::BIGINT AS age_s, strftime(updated_at::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM earnings_events WHERE updated_at IS NOT NULL""")
def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old events are at a frozen clock, and their time in the form that states are written in."""
    at = F.col("updated_at").cast("timestamp")
    e = table(spark, sf_dir, "earnings_events").where("updated_at IS NOT NULL")
    return e.select("event_row", periods.age_seconds(at, F.lit("2027-01-01 00:00:00+00").cast("timestamp")).alias("age_s"), periods.iso_seconds(at).alias("iso"))


@query(r"""
SELECT disclosure_seq, replace(replace(replace(replace(replace('<b>"' || title || '" & ''co''</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, trim('{"t": "' || replace(title, '"', '') || '"}', ' ') AS plain FROM disclosures WHERE title IS NOT NULL""")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for markup, and answers without the code fence around them."""
    said = F.concat(F.lit('{"t": "'), F.replace("title", F.lit('"'), F.lit("")), F.lit('"}'))
    fenced = F.when(F.col("disclosure_seq") % 3 == 0, _join("```json\n", said, "\n```")).when(F.col("disclosure_seq") % 3 == 1, _join(" ```\n", said, "\n``` ")).otherwise(said)
    d = table(spark, sf_dir, "disclosures").where("title IS NOT NULL")
    return d.select("disclosure_seq", text.escape_html(_join('<b>"', F.col("title"), '" & \'co\'</b>')).alias("escaped"), text.without_fence(fenced).alias("plain"))


@query("SELECT event_type, count(*) AS calls, sum(user_id)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of each model; events stand for calls."""
    return evidence.usage(table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens")), ["event_type"])


@query("""
WITH a AS (SELECT user_id, event_id AS n, event_type = 'purchase' AS ok FROM events), f AS (SELECT user_id, min(n) FILTER (WHERE ok) AS used_rank FROM a GROUP BY 1)
SELECT a.user_id, f.used_rank, count(*) AS attempts FROM a JOIN f ON f.user_id = a.user_id WHERE f.used_rank IS NULL OR a.n <= f.used_rank GROUP BY ALL""")
def first_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt of a chain that succeeds, and how many were made up to it."""
    a = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"), (F.col("event_type") == "purchase").alias("ok"))
    return evidence.first_success(a, ["user_id"], "n", "ok")


@query("""
WITH w AS (SELECT DISTINCT event_id AS key, 'f' || (event_row % 3) AS fingerprint, unnest(['facts', 'analysis', 'audit']) AS stage FROM earnings_events),
done AS (SELECT DISTINCT event_id AS key, 'f' || (event_row % 3) AS fingerprint, CASE WHEN event_row % 4 = 0 THEN 'facts' ELSE 'analysis' END AS stage FROM earnings_events WHERE event_row % 5 <> 0)
SELECT w.* FROM w ANTI JOIN done d ON d.key = w.key AND d.fingerprint = w.fingerprint AND d.stage = w.stage""")
def stages_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of events that must run: those not done for this evidence by this version."""
    e, n = table(spark, sf_dir, "earnings_events"), F.col("event_row")
    keyed = e.select(F.col("event_id").alias("key"), _join("f", n % 3).alias("fingerprint"), n)
    wanted = keyed.select("key", "fingerprint", F.explode(F.array(*map(F.lit, ("facts", "analysis", "audit")))).alias("stage")).distinct()
    done = keyed.select("key", "fingerprint", F.when(n % 4 == 0, "facts").otherwise("analysis").alias("stage"), F.when(n % 5 == 0, 1).otherwise(2).alias("pipeline_version"))
    return store.stages_to_run(wanted, done, 2)


@query("""
SELECT disclosure_seq, ticker FROM disclosures WHERE ticker IN (SELECT ticker FROM companies WHERE len(coalesce(patterns, [])) > 1)""")
def scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the companies that a watch list names: those with two patterns or more."""
    from brightloom.operators import events

    listed = table(spark, sf_dir, "companies").where(F.size("patterns") > 1)
    return events.in_scope(table(spark, sf_dir, "disclosures"), listed).select("disclosure_seq", "ticker")


@query("""
SELECT event_id, count(*) AS documents, string_agg(DISTINCT s, ',' ORDER BY s) AS enrichments FROM (SELECT DISTINCT event_id, k, split_part(k, ':', 1) AS s FROM (SELECT event_id, unnest(documents) AS k FROM earnings_events))
WHERE s IN ('alpha_vantage_transcript', 'third_party_transcript', 'official_ir', 'gemini_grounded_ir', 'openai_web_ir') GROUP BY 1""")
def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with documents of a source that enriches them: the union of transcripts' and mirrors' sources."""
    from brightloom.operators import events

    d = table(spark, sf_dir, "earnings_events").select("event_id", F.explode("documents").alias("k")).distinct().withColumn("s", F.substring_index("k", ":", 1))
    return events.enriched(d, "event_id", "s")
