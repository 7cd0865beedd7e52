"""One run of the document pipeline from the command line; prints what became of the documents as JSON lines."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from brightloom.operators.store import Store
from brightloom.plans import ingest
from brightloom.session import ship
from brightloom.sources import filings


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="brightloom", description=__doc__)
    p.add_argument("--watchlist", required=True, help="YAML list of companies")
    p.add_argument("--fixture", required=True, help="JSON array of disclosures")
    p.add_argument("--state", help="folder of the store; without it nothing is kept")
    p.add_argument("--tickers", help="only these companies, parted by commas")
    p.add_argument("--at", help="the run's clock, ISO with offset")
    p.add_argument("--dry-run", action="store_true", help="write nothing")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("brightloom").getOrCreate()
    ship(spark)
    now = a.at or datetime.now(timezone.utc).isoformat(timespec="seconds")
    store = Store(spark, a.state) if a.state else None
    tickers = [t.strip().upper() for t in a.tickers.split(",") if t.strip()] if a.tickers else None
    outcomes, events = ingest.run(filings.read_disclosures(spark, a.fixture), filings.watchlist(spark, a.watchlist), store, now, tickers, a.dry_run)
    for r in outcomes.groupBy("outcome").count().orderBy("outcome").collect():  # a handful
        print(json.dumps({"outcome": r["outcome"], "documents": r["count"]}))
    print(json.dumps({"events": events.count(), "at": now}))


if __name__ == "__main__":
    main()
