"""A run of the document pipeline on what sources deliver: scope, periods, events and outcomes, kept in a versioned store. Runs may be repeated; what is known is told as seen.

`python -m brightloom --fixture d.json --watchlist w.yaml --state FOLDER` does one run; the clock is --at, so that a run can be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators import events
from brightloom.operators.store import Store
from brightloom.session import stored


def run(delivered: DataFrame, companies: DataFrame, store: Store | None, now: str, tickers: list[str] | None = None, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(outcomes, events): what became of each delivered document, and all events with their documents, those of earlier runs too.

    delivered: columns of filings.DISCLOSURE_SCHEMA, in their order. tickers: only these companies, for what is delivered and for the events shown.
    A dry run writes nothing; without a store nothing is known from before."""
    scope = companies.where(F.col("ticker").isin(tickers)) if tickers else companies
    old = store.read("documents") if store else None
    start = (old.agg(F.max("disclosure_seq")).first()[0] or 0) if old is not None else 0
    listed = events.in_scope(delivered, scope) if tickers else delivered
    fresh = listed.withColumn("disclosure_seq", F.lit(start + 1) + F.monotonically_increasing_id()).withColumn("ingested_at", F.lit(now).cast("timestamp")).withColumn("day", events.published_day(F.col("published_at")))
    aligned = events.with_event(events.align_companions(events.with_period(events.latest_deliveries(fresh)), "day"))
    aligned = stored(aligned, "delivered")
    known = old.select("document_key") if old is not None else aligned.select("document_key").limit(0)
    outcomes = stored(events.outcomes(aligned, known, companies, "disclosure_seq", old), "outcomes")
    new = aligned.join(outcomes.where("outcome = 'new'").select("disclosure_seq"), "disclosure_seq", "left_semi")
    every = new if old is None else old.unionByName(new, allowMissingColumns=True)
    formed = events.form_events(every, "disclosure_seq")
    if store and not dry:
        store.save("documents", every)
        store.save("events", formed)
        formed = store.read("events")
    return outcomes, events.in_scope(formed, scope) if tickers else formed
