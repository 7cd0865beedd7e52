"""Evidence around events: matching pages to events, related units, budgets and samples, sources of a report, answers of search models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import periods, urls
from brightloom.functions.text import classify_title, contains_any, escape_html, folded, utf16_units, without_fence
from brightloom.operators.groups import first_rows, top_rows
from brightloom.operators.unitize import even_sample

GROUNDED = "sources array<struct<url: string, title: string, document_kind: string, published_at: string>>"

# Kinds of documents that a search model's answer may name; kinds that accompany results and words for results; labels of an analyst's own taxonomy; words of a report that are put otherwise for its readers; its sections on a call.
COMPANION_KINDS = ["qa", "transcript", "presentation", "supplement", "financial_tables", "performance_review", "prepared_remarks"]
FRESH_TERMS = ["earnings", "financial results", "quarterly results", "conference call", "webcast"]
KNOWN_KINDS = ["qa", "transcript", "presentation", "supplement", "financial_tables", "performance_review", "prepared_remarks", "financial_results"]
INTERNAL_LABEL = r"(?i)\[(?:\s*M[1-5]\s*[|｜]\s*[ABCD]\s*|\s*(?:Driver|Lever|Catalyst|Risk|Missing|Alternative)\s*)\]\s*"
REPORT_WORDS = [(r"(?im)^\s*└\s*Weak link\s*:\s*", "└ 尚未確認: "), (r"(?im)^\s*•\s*Claim\s*:\s*", "• "), (r"\s*\|\s*Evidence\s*:\s*", "；證據：")]
REPORT_HEADERS = [("🏢 業務部門 / 客戶ROI:", "🏢 業務部門:\n└ 客戶/ROI:"), ("🏢 業務部門 / 客戶ROI：", "🏢 業務部門:\n└ 客戶/ROI:")]
CALL_SECTION = r"(?is)\n{2,}🎙️\s*法說\s*Q&A\s*[:：].*?(?=\n{2,}⚖️|\z)"
REPORT_TABLE = ("📈 關鍵指標:\n", "\n\n🏢 業務部門:")
REPORT_UNITS = 4000
# end of fixed values


def match_events(contexts: DataFrame, events: DataFrame, key: str, ticker: str, context: str, day: str | None = None, near: int = 14, fresh: int = 7) -> DataFrame:
    """(key, event_id) of each context that fits one event of its company: by year and quarter if just one has them; else, for a company with one event, by a date
    in the context that lies within `near` days of `day` for what accompanies results, and within `fresh` days where it speaks of results themselves."""
    said = F.coalesce(F.col(context), F.lit(""))
    contexts = contexts.withColumn("_folded", folded(said))
    year, quarter = periods.period_of(F.col("_folded"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    about = F.when(F.coalesce(classify_title(said).isin(COMPANION_KINDS), F.lit(False)), near).when(contains_any(F.lower(said), FRESH_TERMS), fresh)
    c = contexts.select(key, F.col(ticker).alias("_t"), year.alias("_y"), quarter.alias("_q"), (F.col(day) if day else F.lit(None).cast("date")).alias("_day"), periods.nearby_date(said).alias("_near"), about.alias("_within"))
    once = events.groupBy("ticker", "fiscal_year", "quarter").agg(F.min("event_id").alias("by_period"), F.max("event_id").alias("_hi")).where("by_period = _hi")
    named = c.join(once, (F.col("_t") == F.col("ticker")) & (F.col("_y") == F.col("fiscal_year")) & (F.col("_q") == F.col("quarter")), "left").select(*c.columns, "by_period")
    single = events.groupBy(F.col("ticker").alias("_t")).agg(F.min("event_id").alias("only"), F.max("event_id").alias("_hi")).where("only = _hi").drop("_hi")
    both = named.join(single, "_t", "left")
    close = F.abs(F.datediff(F.col("_day"), F.col("_near"))) <= F.col("_within")
    return both.select(key, F.coalesce("by_period", F.when(close, F.col("only"))).alias("event_id")).where("event_id IS NOT NULL")


def related_units(units: DataFrame, document: str, phrase: Column) -> DataFrame:
    """For each unit with a phrase, the ids of its document's other units that hold it, in order. The phrase is found once for all units of a document, not pair by pair."""
    named = units.withColumn("_p", phrase).where("_p IS NOT NULL AND _p <> ''").select(document, "unit_id", "_p")
    asked = named.select(document, "_p").distinct()
    hits = units.join(asked, document).where(F.contains(F.lower("unit"), F.lower("_p"))).groupBy(document, "_p").agg(F.array_sort(F.collect_list(F.struct("position", "unit_id"))).alias("_h"))
    out = named.join(hits, [document, "_p"])
    return out.select("unit_id", F.col("_p").alias("phrase"), F.filter(F.transform("_h", lambda h: h["unit_id"]), lambda u: u != F.col("unit_id")).alias("related"))


def within_budget(rows: DataFrame, by: list[str], order: list[Column], content: str, budget: int) -> DataFrame:
    """Texts of each group in order up to a budget of characters, the last cut to what is left. A group is one document's sections."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length(content)).over(w), F.lit(0))
    return rows.withColumn("_left", left).where("_left > 0").withColumn(content, F.substring(F.col(content), F.lit(1), F.col("_left").cast("int"))).drop("_left")


def positions_sample(n: Column) -> Column:
    """Indices from 0 of a few places in a list of n: its beginning, thirds, middle and end; all of six or fewer."""
    some = F.array(F.lit(0), F.lit(1), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), F.floor(n * 2 / 3).cast("int"), n - 2, n - 1)
    few = even_sample(n, 10**6)
    return F.when(n <= 6, few).otherwise(F.array_sort(F.array_distinct(some)))


def equal_share(rows: DataFrame, by: list[str], content: str, total: int = 48_000) -> DataFrame:
    """Each text cut to its share of a group's budget, the same for all of the group."""
    n = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("_n"))
    return rows.join(n, by).withColumn(content, F.substring(F.col(content), F.lit(1), F.floor(F.lit(total) / F.col("_n")).cast("int"))).drop("_n")


def report_sources(documents: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The sources of a report once each by title, without the XBRL tag, and link; tagged copies of filings are left out."""
    d = documents.where(F.coalesce(F.col("metadata.format"), F.lit("")) != "ixbrl").withColumn("shown", F.regexp_replace("title", r"\s*\[XBRL\]$", ""))
    return first_rows(d, [*by, "shown", "url"], order)


def collection_status(attempts: DataFrame, by: str, ok: str) -> DataFrame:
    """Whether all, some or none of a company's pages could be read."""
    n, good = F.count(F.lit(1)), F.count_if(F.col(ok))
    return attempts.groupBy(by).agg(n.alias("pages"), good.alias("read")).withColumn("status", F.when(F.col("read") == F.col("pages"), "checked").when(F.col("read") > 0, "partial").otherwise("failed"))


def grounded_sources(answers: DataFrame, key: str, answer: str, allowed: str) -> DataFrame:
    """Documents that a search model's answer names, each with whether it is accepted: of a known kind, with a link on an allowed host, once a link."""
    plain = without_fence(F.col(answer))
    s = answers.select(key, F.col(allowed).alias("_allowed"), F.posexplode(F.from_json(plain, GROUNDED)["sources"]).alias("at", "s")).select(key, "_allowed", "at", "s.*")
    s = s.withColumn("link", urls.asset_key(F.coalesce("url", F.lit("")))).withColumn("first_at", F.min("at").over(Window.partitionBy(key, "link")))
    reason = F.when(F.coalesce("url", F.lit("")) == "", "no_link").when(~F.coalesce(F.col("document_kind").isin(KNOWN_KINDS), F.lit(False)), "unknown_kind").when(~F.coalesce(urls.host_allowed(F.col("url"), F.col("_allowed")), F.lit(False)), "other_host").when(F.col("at") > F.col("first_at"), "repeated")
    return s.select(key, "at", "link", "title", "document_kind", F.substring(F.sha2("link", 256), 1, 24).alias("source_id"), reason.alias("rejected"))


def first_success(attempts: DataFrame, by: list[str], rank: str, ok: str) -> DataFrame:
    """Of each group's attempts along a chain of providers, the first that succeeded, and how many were made up to it."""
    best = attempts.groupBy(*by).agg(F.min(F.when(F.col(ok), F.col(rank))).alias("used_rank"), F.count(F.lit(1)).alias("_all"))
    return attempts.join(best, by).where(F.col("used_rank").isNull() | (F.col(rank) <= F.col("used_rank"))).groupBy(*by, "used_rank").agg(F.count(F.lit(1)).alias("attempts"))


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def clean_report(report: Column) -> Column:
    """A report without the analyst's own labels."""
    s = F.regexp_replace(F.coalesce(report, F.lit("")), INTERNAL_LABEL, "")
    for pattern, words in REPORT_WORDS:
        s = F.regexp_replace(s, pattern, words)
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def report_headers(report: Column) -> Column:
    """A clean report with its older combined header split in two lines."""
    s = clean_report(report)
    for old, new in REPORT_HEADERS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def without_call_section(report: Column) -> Column:
    """A report without its section on a call's questions."""
    return F.regexp_replace(F.regexp_replace(report, CALL_SECTION, ""), r"(?U)^\s+|\s+$", "")


def report_markup(report: Column) -> Column:
    """A report escaped for markup; the table between its two headings keeps its columns. A report without both headings is only escaped."""
    opens, closes = REPORT_TABLE
    at = F.instr(report, opens)
    rest = F.substring(report, at + len(opens), F.lit(2**30))
    end = F.instr(rest, closes)
    table = F.regexp_replace(F.substring(rest, F.lit(1), end - 1), r"(?U)^\s+|\s+$", "")
    framed = F.concat(escape_html(F.substring(report, F.lit(1), at - 1)), F.lit(f"{opens}<pre>"), escape_html(table), F.lit(f"</pre>{closes}"), escape_html(F.substring(rest, end + len(closes), F.lit(2**30))))
    return F.when((at > 0) & (end > 0), framed).otherwise(escape_html(report))


def composed(reports: DataFrame, documents: DataFrame, key: str, body: str, order: list[Column], title: str = "資料來源") -> DataFrame:
    """(key, message, units, fits) of each report with its sources below: each of them once by title and link, escaped, in order.

    units: its size in UTF-16 units, by which messages are limited. A report's sources are the documents of one event."""
    lines = report_sources(documents, [key], order).select(key, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.concat(F.lit('• <a href="'), escape_html(F.coalesce("url", F.lit(""))), F.lit('">'), escape_html(F.coalesce("shown", F.lit(""))), F.lit("</a>")).alias("line"))
    below = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("_below"))
    message = F.concat(F.trim(F.coalesce(body, F.lit(""))), F.lit(f"\n\n{title}:\n"), F.coalesce("_below", F.lit("")))
    out = reports.join(below, key, "left").select(key, message.alias("message"))
    return out.select(key, "message", utf16_units(F.col("message")).alias("units"), (utf16_units(F.col("message")) <= REPORT_UNITS).alias("fits"))


def last_hours(articles: DataFrame, at: str, now: Column, hours: int, by: list[str], k: int) -> DataFrame:
    """The latest k articles of each group within some hours before now."""
    recent = articles.where(F.col(at).between(now - F.make_interval(hours=F.lit(hours)), now))
    return top_rows(recent, by, [F.desc(at)], k)
