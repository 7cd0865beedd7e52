"""Filing indexes, watch lists, transcripts and other records as tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import periods, text
from brightloom.operators.events import CURRENT_FORMS, PERIODIC_FORMS, nearest_periodic, quarterly_count

# Where filings lie; words of exhibits about results; words of a call and of its dialogue.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"
RESULT_TERMS = ["earnings", "financial results", "quarterly results", "annual results", "shareholder letter", "investor presentation", "earnings presentation", "results presentation", "press release"]
CALL_WORDS = "earnings call transcript|conference call"
DIALOGUE_WORDS = "question-and-answer|question and answer|operator|your line is open|open up the call for questions"
# end of fixed values

INDEX_SCHEMA = (
    "cik string, fiscalYearEnd string, filings struct<recent: struct<accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, acceptanceDateTime: array<string>,"
    " form: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>, items: array<string>>>"
)
DISCLOSURE_SCHEMA = (
    "source string, source_id string, ticker string, title string, published_at string, url string, document_url string, fiscal_year int, quarter string, period_end string, document_kind string,"
    " metadata struct<form: string, document_type: string, filing_date: string, format: string, provenance: string, qualitative_only: boolean>"
)


class SourceAdapter(Protocol):
    """A source of disclosures: what it has of some companies (ticker, cik, name and so on) up to a day, as a DataFrame with columns of DISCLOSURE_SCHEMA."""

    name: str

    def discover(self, companies: DataFrame, day: str) -> DataFrame: ...


class FileAdapter:
    """Disclosures that lie as a JSON array in a file or folder."""

    def __init__(self, spark: SparkSession, path: str, name: str = "file"):
        self.spark, self.path, self.name = spark, path, name

    def discover(self, companies: DataFrame, day: str) -> DataFrame:
        return read_disclosures(self.spark, self.path).join(companies.select("ticker"), "ticker", "left_semi").where(F.coalesce(F.substring("published_at", 1, 10) <= day, F.lit(True)))


class IndexAdapter:
    """Filings of companies by their indexes and the files that these list (accessionNumber, description, document_type, url)."""

    def __init__(self, index: DataFrame, attachments: DataFrame, days: int = 3, name: str = "sec_edgar"):
        self.index, self.attachments, self.days, self.name = index, attachments, days, name

    def discover(self, companies: DataFrame, day: str) -> DataFrame:
        placed = with_related_period(with_report_period(records(self.index)))  # periods are told by all of a company's filings, also older ones
        return documents_of(in_window(placed, day, self.days), self.attachments, companies)


def discover_all(adapters: list[SourceAdapter], companies: DataFrame, day: str) -> DataFrame:
    """What all sources have, with the columns and types of DISCLOSURE_SCHEMA; columns that a source hasn't are null."""
    want = companies.sparkSession.createDataFrame([], DISCLOSURE_SCHEMA)
    out = want
    for a in adapters:
        found = a.discover(companies, day)
        out = out.unionByName(found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.schema]))
    return out


def read_disclosures(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of disclosures, with the fixed schema; missing fields are null."""
    return spark.read.schema(DISCLOSURE_SCHEMA).option("multiLine", True).json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a YAML list, their patterns in lower case."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    patterns = [str(p).casefold() for p in data.get("title_patterns") or data.get("patterns") or []]
    rows = [
        (c.get("ticker"), c.get("name"), str(c.get("cik") or "").zfill(10), c.get("ir_index_url"), c.get("ir_additional_urls") or [], c.get("official_domains") or [], patterns)
        for c in data.get("companies") or []
    ]
    return spark.createDataFrame(rows, "ticker string, name string, cik string, ir_index_url string, ir_additional_urls array<string>, official_domains array<string>, patterns array<string>")


def records(index: DataFrame) -> DataFrame:
    """An index's parallel arrays as rows in their order; missing ends of uneven arrays are empty texts."""
    names = ["accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument", "primaryDocDescription", "items"]
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"filings.recent.{n}"), F.array().cast("array<string>")).alias(n) for n in names])
    rows = index.select("cik", F.coalesce("fiscalYearEnd", F.lit("")).alias("fiscal_year_end"), F.posexplode(zipped).alias("seq", "r"))
    return rows.select("cik", "fiscal_year_end", "seq", *[F.coalesce(F.col(f"r.{n}"), F.lit("")).alias(n) for n in names])


def current_form_kept(form: Column, items: Column) -> Column:
    """Current reports about results: 8-K of items 2.02 or 7.01, and any 6-K."""
    return F.when(F.upper(form).startswith("8-K"), items.contains("2.02") | items.contains("7.01")).otherwise(F.upper(form).startswith("6-K"))


def in_window(rows: DataFrame, day: str, days: int = 3) -> DataFrame:
    """Filings of the last days of the periodic and current forms; the date filter is on the plain column and can reach the scan."""
    form = F.upper("form")
    near = F.col("filingDate").between(F.date_sub(F.lit(day).cast("date"), days).cast("string"), F.lit(day))
    return rows.where(near & (form.isin(PERIODIC_FORMS) | (form.isin(CURRENT_FORMS) & current_form_kept(F.col("form"), F.col("items")))))


def with_report_period(rows: DataFrame, key: str = "cik") -> DataFrame:
    """Adds each record's quarter and fiscal year by its form and report date. A quarterly report whose month tells no quarter, or the fourth, is numbered by counting
    the company's quarterly reports after its last annual one."""
    form = F.upper("form")
    by_date = periods.quarter_of_period_end(F.nullif("reportDate", F.lit("")), F.col("fiscal_year_end"))
    report = F.coalesce("reportDate", F.lit(""))
    counted = quarterly_count(rows.select(F.col(key), report.alias("_report"), form.alias("_form")).distinct(), key, "_report", "_form").groupBy(key, "_report").agg(F.min("counted_quarter").alias("_counted"))
    rows = rows.withColumn("_report", report).join(counted, [key, "_report"], "left")
    by_count = F.when(by_date.isNull() | (by_date == "Q4"), F.coalesce("_counted", F.lit("Q1"))).otherwise(by_date)
    rows = rows.withColumn("_folded", text.folded(F.col("primaryDocDescription")))
    said = periods.period_of(F.col("_folded"), F.lit(None).cast("int"), F.lit(None).cast("string"))[1]
    quarter = F.when(form.rlike("^(?:10-K|20-F|40-F)"), "Q4").when(form.startswith("10-Q"), by_count).otherwise(said)
    return rows.withColumn("quarter", quarter).withColumn("fiscal_year", periods.fiscal_year_of(F.nullif("reportDate", F.lit("")), F.col("fiscal_year_end"))).drop("_report", "_counted", "_folded")


def with_related_period(rows: DataFrame, key: str = "cik") -> DataFrame:
    """Current reports with the report date and quarter of the company's nearest periodic report filed within three days, where there is one; the first listed of two."""
    form = F.upper("form")
    dated = rows.withColumn("_day", F.try_to_date("filingDate", "yyyy-MM-dd"))
    periodic = dated.where(form.isin(PERIODIC_FORMS) & (F.coalesce("reportDate", F.lit("")) != "")).select(key, "_day", F.struct("reportDate", "quarter").alias("_period"), "seq")
    current = nearest_periodic(dated.where(form.isin(CURRENT_FORMS)), periodic, key, "_day", "_period")
    p = F.col("report_date")
    moved = current.withColumn("reportDate", F.coalesce(p["reportDate"], "reportDate")).withColumn("quarter", F.coalesce(p["quarter"], "quarter"))
    moved = moved.withColumn("fiscal_year", periods.fiscal_year_of(F.nullif("reportDate", F.lit("")), F.col("fiscal_year_end"))).select(*rows.columns)
    return rows.where(~F.coalesce(form.isin(CURRENT_FORMS), F.lit(False))).unionByName(moved)


def documents_of(rows: DataFrame, attachments: DataFrame, companies: DataFrame) -> DataFrame:
    """Filings as disclosures: the primary document of each periodic report, and of each current one the documents that are its form's own or exhibits of results.

    rows: records with quarter and fiscal_year. attachments: accessionNumber, description, document_type, url. companies: cik, ticker, name. An exhibit's period is that of its
    file name, else of a date in it, else of its record, else of its title."""
    form = F.upper("form")
    named = rows.withColumn("form", form).join(companies.select("cik", "ticker", "name"), "cik")
    primary = named.where(F.col("form").isin(PERIODIC_FORMS)).withColumns({
        "description": F.coalesce(F.nullif("primaryDocDescription", F.lit("")), F.concat(F.lit("Form "), F.col("form"))), "document_type": F.col("form"),
        "url": F.concat(F.lit(ARCHIVE), F.col("cik").try_cast("long").cast("string"), F.lit("/"), F.replace("accessionNumber", F.lit("-"), F.lit("")), F.lit("/"), F.col("primaryDocument")),
    })
    other = named.where(F.col("form").isin(CURRENT_FORMS)).join(attachments, "accessionNumber").select(*primary.columns)
    d = primary.unionByName(other).withColumn("file", F.regexp_extract("url", r"([^/]*)$", 1))
    own, exhibit = F.col("document_type") == F.col("form"), F.col("document_type").startswith("EX-99")
    current = F.col("form").isin(CURRENT_FORMS)
    told = F.lower(F.concat_ws(" ", "description", F.coalesce("primaryDocDescription", F.lit("")), "file"))
    d = d.where(~current | own | exhibit).where(~F.col("form").startswith("6-K") | own | text.contains_any(told, RESULT_TERMS))
    dated = F.when(exhibit, periods.date_in_filename(F.col("file"), F.try_to_date("filingDate", "yyyy-MM-dd"))).cast("string")
    year, quarter = periods.period_in_filename(F.col("file"))
    d = d.withColumns({"_dated": dated, "_fy": year, "_fq": quarter})
    shown = F.when(exhibit & (F.col("_fq").isNotNull() | F.col("_dated").isNotNull()), F.col("file")).otherwise(F.col("description"))
    shown = F.when(exhibit & current, F.concat(F.lit("Earnings Release / Exhibit "), F.col("document_type"), F.lit(" — "), shown)).otherwise(shown)
    d = d.withColumn("title", F.concat(F.col("name"), F.lit(" Form "), F.col("form"), F.lit(" — "), shown))
    d = d.withColumn("_folded", text.folded(F.col("title")))
    title_year, title_quarter = periods.period_of(F.col("_folded"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    return d.select(
        F.lit("sec_edgar").alias("source"), F.concat_ws(":", "accessionNumber", "file").alias("source_id"), "ticker", "title",
        F.coalesce(F.nullif("acceptanceDateTime", F.lit("")), F.concat(F.col("filingDate"), F.lit("T00:00:00-04:00"))).alias("published_at"), "url", F.col("url").alias("document_url"),
        F.coalesce("_fy", periods.fiscal_year_of(F.col("_dated"), F.col("fiscal_year_end")), "fiscal_year", title_year).alias("fiscal_year"),
        F.coalesce("_fq", periods.quarter_of_period_end(F.col("_dated"), F.col("fiscal_year_end")), "quarter", title_quarter).alias("quarter"),
        F.coalesce("_dated", F.nullif("reportDate", F.lit(""))).alias("period_end"), F.col("form"), F.col("document_type"), F.col("filingDate").alias("filing_date"),
    )


def attachment_period(df: DataFrame, name: str, filed: str) -> DataFrame:
    """Period of an exhibit: by year and quarter in its file name, else by a date in it, else the record's own."""
    year, quarter = periods.period_in_filename(F.col(name))
    dated = periods.date_in_filename(F.col(name), F.to_date(filed))
    df = df.withColumn("_d", dated.cast("string")).withColumn("_fy", year).withColumn("_fq", quarter)
    return df.select(
        *[c for c in df.columns if c not in ("_d", "_fy", "_fq", "quarter", "fiscal_year")],
        F.coalesce("_fy", periods.fiscal_year_of(F.col("_d"), F.col("fiscal_year_end")), "fiscal_year").alias("fiscal_year"),
        F.coalesce("_fq", periods.quarter_of_period_end(F.col("_d"), F.col("fiscal_year_end")), "quarter").alias("quarter"),
        F.coalesce("_d", F.nullif("reportDate", F.lit(""))).alias("period_end"),
    )


def transcript_text(turns: Column) -> Column:
    """Turns (speaker, name, title, content, text) as "speaker (title): content" parted by blank lines; empty turns are left out, and so is a title that is in the speaker's name."""
    def line(t: Column) -> Column:
        who = F.trim(F.coalesce(F.nullif(t["speaker"], F.lit("")), t["name"], F.lit("")))
        title = F.trim(F.coalesce(t["title"], F.lit("")))
        said = F.trim(F.coalesce(F.nullif(t["content"], F.lit("")), t["text"], F.lit("")))
        label = F.when((title != "") & ~F.contains(F.lower(who), F.lower(title)), F.when(who != "", F.concat(who, F.lit(" ("), title, F.lit(")"))).otherwise(title)).otherwise(who)
        return F.when(said != "", F.when(label != "", F.concat(label, F.lit(": "), said)).otherwise(said))

    return F.trim(F.array_join(F.array_compact(F.transform(turns, line)), "\n\n"))


def looks_like_transcript(text: Column, ticker: Column, company: Column, least: int = 5000) -> Column:
    """Long enough, names the company by its ticker or its name's first word, and has a call's and a dialogue's words."""
    low = F.lower(text)
    word = F.lower(F.element_at(F.split(F.trim(company), r"\s+"), 1))
    named = F.coalesce((ticker != "") & F.contains(low, F.lower(ticker)), F.lit(False)) | F.coalesce((word != "") & F.contains(low, word), F.lit(False))
    return (F.length(text) >= least) & named & low.rlike(CALL_WORDS) & low.rlike(DIALOGUE_WORDS)


def call_documents(calls: DataFrame, source: str, provider: str) -> DataFrame:
    """Fetched transcripts of events as disclosures. calls: ticker, name, fiscal_year, quarter, period_end, url, said. Calls without a period are left out; source_id is a digest of company, period and provider."""
    digit = F.regexp_extract(F.coalesce("quarter", F.lit("")), "[1-4]", 0)
    known = calls.where(F.col("fiscal_year").isNotNull() & (digit != "")).withColumn("_q", F.concat(F.lit("Q"), digit))
    year = F.col("fiscal_year").cast("string")
    return known.select(
        F.lit(source).alias("source"), F.substring(F.sha2(F.concat_ws(":", "ticker", year, "_q", F.lit(provider)), 256), 1, 24).alias("source_id"), "ticker",
        F.concat(F.col("name"), F.lit(" FY"), year, F.lit(" "), F.col("_q"), F.lit(f" Earnings Call Transcript (third-party: {provider})")).alias("title"), "url", "fiscal_year", F.col("_q").alias("quarter"), "period_end",
        F.lit("transcript").alias("document_kind"), F.lit("third_party_transcript").alias("provenance"), F.lit(True).alias("qualitative_only"), "said",
    )
