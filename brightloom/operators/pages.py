"""Links of companies' pages as documents of their events: which links matter, which event they belong to, and pages one level down.

Defined cases: pages without html have no links; companies without a host allow none; a link that fits no event is dropped; of links to one target on a page the first that
may be followed counts; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text, urls
from brightloom.operators.evidence import match_events
from brightloom.operators.groups import first_rows, top_rows

# Words of links that matter, of documents and of event pages; suffixes of documents and of pages; how many event pages of a page are followed.
LINK_TERMS = [
    "決算", "業績", "説明", "質疑", "qa", "q&a", "transcript", "financial results", "earnings", "presentation", "supplement", "briefing", "fact book", "quarterly", "quarter", "investor relations", "shareholder",
    "financial tables", "performance review", "prepared remarks", "webcast", "conference call",
]
DOCUMENT_TERMS = [
    "qa", "q&a", "transcript", "presentation", "supplement", "financial tables", "performance review", "prepared remarks", "earnings release", "press release", "financial results", "earnings",
    "webcast", "audio replay", "replay",
]
EVENT_PAGE_TERMS = ["earnings", "financial results", "quarterly results", "results", "fiscal year", "quarter"]
DOCUMENT_SUFFIX = r"\.(?:pdf|htm|html|xlsx|xls|txt)$"
PAGE_SUFFIX = r"^(?:|htm|html|php|aspx)$"
MOST_EVENT_PAGES = 8
# end of fixed values


def file_suffix(target: Column) -> Column:
    """What is after the last dot of a link's last part, in lower case; empty where there is no dot."""
    return F.regexp_extract(F.lower(urls.path(target)), r"\.([^./]*)$", 1)


def looks_like_document(target: Column, context: Column) -> Column:
    path = F.lower(urls.path(target))
    page = path.contains("/events/") & ~path.rlike(r"\.html?$")
    return ~page & (path.rlike(DOCUMENT_SUFFIX) | text.contains_any(F.lower(context), DOCUMENT_TERMS))


def looks_like_event_page(target: Column, context: Column) -> Column:
    return file_suffix(target).rlike(PAGE_SUFFIX) & text.contains_any(F.lower(context), EVENT_PAGE_TERMS)


def allowed_hosts(companies: DataFrame) -> DataFrame:
    """(ticker, hosts): those of a company's pages and its own domains."""
    listed = F.concat(F.array("ir_index_url"), F.coalesce("ir_additional_urls", F.array().cast("array<string>")))
    own = F.transform(F.coalesce("official_domains", F.array().cast("array<string>")), lambda d: F.regexp_replace(F.lower(d), r"^\.+", ""))
    hosts = F.concat(F.transform(F.array_compact(listed), urls.host), own)
    return companies.select("ticker", F.array_distinct(F.filter(hosts, lambda h: h != "")).alias("hosts"))


def page_documents(links: DataFrame, companies: DataFrame, events: DataFrame, page: str = "page_id", day: str = "day") -> DataFrame:
    """Links with a word that matters, on a host of the page's company, that fit one of its events by their context or by the page's headline.

    links: page, ticker, day, at, target, label, context, headline, kind. Gives page, ticker, at, target, event_id, title, source_id, format, document_kind, is_document, is_event_page."""
    rows = links.withColumn("target", urls.asset_key(F.col("target"))).join(allowed_hosts(companies), "ticker").where(text.contains_any(F.lower("context"), LINK_TERMS) & urls.host_allowed(F.col("target"), F.col("hosts"))).drop("hosts")
    rows = rows.withColumn("_id", F.concat_ws(":", F.col(page), F.col("at")))
    by_context = match_events(rows, events, "_id", "ticker", "context", day).withColumnRenamed("event_id", "_by_context")
    headlines = rows.where("headline <> ''").select(page, "ticker", "headline", day).distinct()
    by_headline = match_events(headlines, events, page, "ticker", "headline", day).withColumnRenamed("event_id", "_by_headline")
    matched = rows.join(by_context, "_id", "left").join(by_headline, page, "left").withColumn("event_id", F.coalesce("_by_context", "_by_headline"))
    script = F.col("kind") == "script"
    first = first_rows(matched.where(~script | F.col("event_id").isNotNull()), [page, "target"], [script, F.col("at")]).where("event_id IS NOT NULL")
    squeezed = F.trim(F.regexp_replace("context", r"(?U)\s+", " "))
    title = F.when(script, squeezed).when(text.contains_any(F.lower("label"), LINK_TERMS), F.col("label")).otherwise(F.substring("context", 1, 200))
    title = F.substring(F.coalesce(F.nullif(title, F.lit("")), F.col("target")), 1, 220)
    suffix = F.coalesce(F.nullif(file_suffix(F.col("target")), F.lit("")), F.lit("unknown"))
    return first.select(
        page, "ticker", "at", "target", "event_id", title.alias("title"), F.substring(F.sha2("target", 256), 1, 24).alias("source_id"), suffix.alias("format"), text.classify_title(title).alias("document_kind"),
        (script | looks_like_document(F.col("target"), F.col("context"))).alias("is_document"), (~script & looks_like_event_page(F.col("target"), F.col("context"))).alias("is_event_page"),
    )


def crawled(found: DataFrame, pages: DataFrame, roots: DataFrame, page: str = "page_id", most: int = MOST_EVENT_PAGES) -> DataFrame:
    """(page, hop, target, title, event_id, missing) of the documents of each root page and of the first event pages that it names: each target once, the nearest and first kept.

    pages: page, url. roots: the pages to start at. An event page that isn't there is told by a row with missing true and its link as target."""
    at_url = pages.groupBy(urls.asset_key(F.col("url")).alias("target")).agg(F.min(page).alias("_to"))
    own = found.join(roots.select(page).distinct(), page, "left_semi")
    hops = top_rows(own.where("is_event_page"), [page], [F.col("at"), F.col("target")], most, "hop").select(page, "target", "hop").join(at_url, "target", "left")
    docs = found.where("is_document").select(F.col(page).alias("_to"), "at", F.col("target").alias("_t"), "title", "event_id")
    below = hops.where("_to IS NOT NULL").join(docs, "_to").select(page, "hop", "at", F.col("_t").alias("target"), "title", "event_id")
    every = own.where("is_document").select(page, F.lit(0).alias("hop"), "at", "target", "title", "event_id").unionByName(below)
    kept = first_rows(every, [page, "target"], [F.col("hop"), F.col("at")]).select(page, "hop", "target", "title", "event_id", F.lit(False).alias("missing"))
    lost = hops.where("_to IS NULL").select(page, "hop", "target", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("event_id"), F.lit(True).alias("missing"))
    return kept.unionByName(lost)
