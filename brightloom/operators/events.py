"""Disclosures into events: classification, periods of companion documents, joins with what is known, formation and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import periods, text
from brightloom.operators.groups import first_rows

# Titles that anchor a result period; sources that mirror primary ones; kinds and sources that a manifest flags.
ANCHORS = ["form 10-q", "form 10-k", "financial results", "earnings results", "earnings release", "quarterly results"]
MIRROR_SOURCES = ["official_ir", "gemini_grounded_ir", "openai_web_ir"]
PRIMARY_KINDS = ["financial_results", "financial_tables", "performance_review"]
TRANSCRIPT_KINDS = ["transcript", "qa", "prepared_remarks"]
ENRICHMENT_SOURCES = ["alpha_vantage_transcript", "third_party_transcript"]
PERIODIC_FORMS = ["10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
CURRENT_FORMS = ["8-K", "8-K/A", "6-K", "6-K/A"]
# end of fixed values


def document_key(source: str = "source", source_id: str = "source_id") -> Column:
    return F.concat(F.col(source), F.lit(":"), F.col(source_id))


def latest_deliveries(disclosures: DataFrame) -> DataFrame:
    """Each document as last delivered; the smaller disclosure_seq of two at the same time."""
    df = disclosures.withColumn("document_key", document_key())
    return first_rows(df, ["document_key"], [-F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62))), F.col("disclosure_seq")])


def with_period(df: DataFrame) -> DataFrame:
    """Adds inferred_year and inferred_quarter by the document's own fields and its title."""
    year, quarter = periods.period_of(F.col("_folded"), F.col("fiscal_year"), F.col("quarter"))
    return df.withColumn("_folded", text.folded(F.col("title"))).select(*[c for c in df.columns if c not in ("inferred_year", "inferred_quarter")], year.alias("inferred_year"), quarter.alias("inferred_quarter"))


def align_companions(df: DataFrame, day: str) -> DataFrame:
    """Documents without a whole period of their own take that of the one result period of their company and day, if there is just one.

    df has inferred_year and inferred_quarter. The day's periods are collected as at most two values a group, so that hot companies are no burden."""
    anchor = text.contains_any(F.lower("title"), ANCHORS) & F.col("inferred_year").isNotNull() & F.col("inferred_quarter").isNotNull()
    period = F.struct(F.col("inferred_year").alias("y"), F.col("inferred_quarter").alias("q"), F.coalesce("period_end", F.lit("")).alias("e"))
    days = df.where(anchor & F.col("ticker").isNotNull() & F.col(day).isNotNull()).groupBy("ticker", day).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    one = days.where("_lo = _hi").select("ticker", day, F.col("_lo").alias("_one"))
    own = F.col("inferred_year").isNotNull() & F.col("inferred_quarter").isNotNull() & F.col("period_end").isNotNull()
    take = F.col("_one").isNotNull() & ~own
    joined = df.join(one, ["ticker", day], "left")
    return joined.select(
        *[c for c in df.columns if c not in ("inferred_year", "inferred_quarter", "period_end")],
        F.when(take, F.col("_one.y")).otherwise(F.col("inferred_year")).alias("inferred_year"),
        F.when(take, F.col("_one.q")).otherwise(F.col("inferred_quarter")).alias("inferred_quarter"),
        F.when(take, F.nullif(F.col("_one.e"), F.lit(""))).otherwise(F.col("period_end")).alias("period_end"),
        take.alias("aligned"),
    )


def published_day(published: Column) -> Column:
    """The day that a publication's text begins with, as text; null where it begins otherwise: such texts are to be normalised first."""
    return F.nullif(F.regexp_extract(published, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def with_event(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", periods.event_key(F.col("ticker"), F.col("inferred_year"), F.col("inferred_quarter"), F.col("period_end")))


def suppress_mirrors(df: DataFrame, seq: str, earlier: DataFrame | None = None) -> DataFrame:
    """Documents that aren't a mirror of an earlier primary document of their event with the same title.

    earlier: documents of events from before, with the same columns; they count as primary documents but don't come out."""
    keyed = df.withColumn("_title", text.title_key(F.col("title")))
    names = ["event_id", "_title", "source", "metadata", seq]
    all_ = keyed.select(*names) if earlier is None else keyed.select(*names).unionByName(earlier.withColumn("_title", text.title_key(F.col("title"))).select(*names))
    primary = all_.where(~F.col("source").isin(MIRROR_SOURCES) & (F.coalesce(F.col("metadata.format"), F.lit("")) != "ixbrl") & F.col("event_id").isNotNull())
    firsts = primary.groupBy("event_id", "_title").agg(F.min(seq).alias("_first"))
    joined = keyed.join(firsts, ["event_id", "_title"], "left")
    mirror = F.col("source").isin(MIRROR_SOURCES) & F.coalesce(F.col("_first") < F.col(seq), F.lit(False))
    return joined.where(~mirror).select(*df.columns)


def form_events(df: DataFrame, seq: str) -> DataFrame:
    """A row an event: its distinct documents in the order in which they first came, their number, and the first document's key and period.

    A document is counted once on the map side; an event's distinct documents are gathered in one row, as they are its state."""
    first = F.min(F.struct(F.col(seq).alias("s"), F.col("document_key").alias("k"), F.col("inferred_year").alias("y"), F.col("inferred_quarter").alias("q"), F.col("period_end").alias("e"))).alias("f")
    placed = df.where("event_id IS NOT NULL")
    keys = placed.where("document_key IS NOT NULL").groupBy("event_id", "document_key").agg(F.min(seq).alias("s")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("s", "document_key"))).alias("keys"))
    found = placed.groupBy("event_id").agg(F.max(seq).alias("last_seq"), F.min("ticker").alias("ticker"), first).join(keys, "event_id", "left")
    keys = F.coalesce(F.transform("keys", lambda k: k["document_key"]), F.array().cast("array<string>"))
    return found.select("event_id", "ticker", keys.alias("document_keys"), F.size(keys).cast("long").alias("documents"), F.col("f.k").alias("first_key"), F.col("f.y").alias("fiscal_year"), F.col("f.q").alias("quarter"), F.col("f.e").alias("period_end"), "last_seq")


def outcomes(df: DataFrame, known: DataFrame, patterns: DataFrame, seq: str, earlier: DataFrame | None = None) -> DataFrame:
    """What becomes of each document on the way in: unlisted, not_results, seen, ungroupable, mirror or new.

    known: (document_key) already stored. earlier: stored documents that mirrors may be of. patterns: (ticker, patterns) of title words that also count as results."""
    d = df.join(patterns.select("ticker", "patterns"), "ticker", "left").join(known.select("document_key").distinct().withColumn("_known", F.lit(True)), "document_key", "left")
    results = (text.classify_title(F.col("title")) != "other") | F.coalesce(F.exists("patterns", lambda p: F.lower("title").contains(p)), F.lit(False))
    d = d.withColumn("_results", results)
    kept = suppress_mirrors(d.where(F.col("_known").isNull() & F.col("_results")).select(*df.columns), seq, earlier).select(F.col(seq), F.lit(True).alias("_kept"))
    d = d.join(kept, seq, "left")
    label = F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", "unlisted").when(~F.col("_results"), "not_results").when(F.col("_known"), "seen").when(F.col("event_id").isNull(), "ungroupable").when(F.col("_kept"), "new").otherwise("mirror")
    return d.select(seq, "document_key", label.alias("outcome"))


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: documents, counts by kind and by source as maps, and flags."""
    kinds = df.groupBy(*by, "document_kind").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("document_kind", F.lit("")).alias("k"), "n"))).alias("kinds"))  # a few kinds a group
    sources = df.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("k"), "n"))).alias("sources"))
    flags = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.coalesce(F.bool_or(F.col(c).isin(v)), F.lit(False)).alias(n) for n, c, v in (
            ("has_primary_results", "document_kind", PRIMARY_KINDS), ("has_official_ir", "source", MIRROR_SOURCES), ("has_transcript_or_qa", "document_kind", TRANSCRIPT_KINDS),
            ("has_transcript_enrichment", "source", ENRICHMENT_SOURCES), ("has_financial_tables", "document_kind", ["financial_tables"]),
            ("has_performance_review", "document_kind", ["performance_review"]), ("has_presentation", "document_kind", ["presentation"]),
        )],
    )
    as_map = lambda c: F.map_from_entries(c)
    return flags.join(kinds, by).join(sources, by).select(*by, "documents", as_map(F.col("kinds")).alias("kinds"), as_map(F.col("sources")).alias("sources"), *flags.columns[len(by) + 1 :])


def nearest_periodic(current: DataFrame, periodic: DataFrame, key: str, day: str, report: str, most: int = 3) -> DataFrame:
    """The report date of the periodic filing nearest in days to each current one, within `most` days; the earlier seq on a tie.

    An equi-join on company and each day of the window, so that a hot company meets its neighbours in time only."""
    wide = periodic.select(key, F.col(day).alias("_pday"), F.col(report).alias("_report"), F.col("seq").alias("_pseq")).where("_report IS NOT NULL AND _pday IS NOT NULL")
    per_day = wide.groupBy(key, "_pday").agg(F.min(F.struct("_pseq", "_report")).alias("_p"))  # of one day, the first
    spread = per_day.withColumn("_gap", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(day, F.date_add("_pday", F.col("_gap")))
    best = spread.groupBy(key, day).agg(F.min(F.struct(F.abs("_gap").alias("g"), F.col("_p._pseq").alias("s"), F.col("_p._report").alias("r"))).alias("b"))
    return current.join(best, [key, day], "left").select(*current.columns, F.col("b.g").alias("gap_days"), F.col("b.s").alias("periodic_seq"), F.col("b.r").alias("report_date"))


def latest_state(snapshots: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The last snapshot of each key; the greater seq of two at the same time. This is also the merge of a state with its updates."""
    return first_rows(snapshots, [key], [-F.coalesce(F.unix_micros(at), F.lit(-(2**62))), -F.col(seq)])


def quarterly_count(filings: DataFrame, key: str, report: str, form: str) -> DataFrame:
    """Each quarterly report's quarter by counting the company's distinct quarterly reports after its last annual one, from 1 to 3.

    Report dates of a company are few and distinct; they are gathered once a company as sorted arrays and looked up by row."""
    dates = filings.where(F.col(report).isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col(form).rlike("^(?:10-K|20-F|40-F)"), F.col(report)))).alias("_annual"),
        F.array_sort(F.collect_set(F.when(F.col(form).startswith("10-Q"), F.col(report)))).alias("_quarterly"),
    )
    q = filings.where(F.col(form).startswith("10-Q") & F.col(report).isNotNull()).join(dates, key)
    last = F.coalesce(F.array_max(F.filter("_annual", lambda d: d < F.col(report))), F.lit(""))
    n = F.size(F.filter("_quarterly", lambda d: (d > last) & (d <= F.col(report))))
    return q.select(*filings.columns, F.concat(F.lit("Q"), F.least(F.lit(3), F.greatest(F.lit(1), n))).alias("counted_quarter"))


def in_scope(df: DataFrame, listed: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows of the listed companies; a row without a company is in no scope."""
    return df.join(listed.select(key), key, "left_semi")


def enriched(documents: DataFrame, by: str, source: str) -> DataFrame:
    """Of each group with documents of a source that enriches results: their number and the sources, sorted. Sources are a handful, so a group's set is small."""
    kinds = sorted({*ENRICHMENT_SOURCES, *MIRROR_SOURCES})
    return documents.where(F.col(source).isin(kinds)).groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("enrichments"))
