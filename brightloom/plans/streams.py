"""Queries that run as streams over what is in the tables, and the SQL that says the same of a whole table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import events as ev
from brightloom.plans.documents import _EVENT, _PERIODS
from brightloom.session import table
from brightloom.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: the frozen clock of queries that ask what is so now.
NOW = datetime(2024, 1, 31, 0, 0, 0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return state.read(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name))


@query("SELECT event_type, count(*) AS events FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each by id."""
    once = state.without_repeats(_stream(spark, sf_dir, "events"), ["event_id"], "ts")
    return state.run_to_end(once.select("event_id", "event_type"), "once").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals; every day comes out, the open ones too, as updates of the last state."""
    w = state.windowed(_stream(spark, sf_dir, "events"), "ts", ["event_type"], "1 day")
    last = state.run_to_end(w, "daily", "update").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r"))
    return last.select("window_start", "event_type", F.col("r.n").alias("n"), F.round("r.total", 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users without a pause of half an hour."""
    return state.sessions(table(spark, sf_dir, "events"), "ts", "user_id").select("user_id", "session_start", "n")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, over the whole table: the open sessions too, as the last batch's state has them; that state keeps closed ones as well."""
    rows = state.run_to_end(state.sessions(_stream(spark, sf_dir, "events"), "ts", "user_id"), "sessions", "complete")
    last = rows.agg(F.max("_batch")).first()[0]
    return rows.where(F.col("_batch") == F.lit(last)).drop("_batch")


@query(f"""
WITH {_PERIODS}, e AS (SELECT document_key, {_EVENT} AS event_id FROM inferred) SELECT event_id, 1 AS version, count(DISTINCT document_key)::INT AS documents, 'new' AS cause FROM e WHERE event_id IS NOT NULL GROUP BY 1""")
def stream_event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their documents as these come in; late ones open a new version. All that is there comes in one batch here, so that each event has one version."""
    d = _stream(spark, sf_dir, "disclosures").withColumn("document_key", ev.document_key())
    keyed = ev.with_event(ev.with_period(d)).select("event_id", "document_key")
    return state.run_to_end(state.follow_events(keyed), "versions", "update").drop("_batch")


@query("""
SELECT provider, open FROM (SELECT user_id % 7 AS provider, arg_max(ok, (ts, ok::INT)) = false AND max(ts)::TIMESTAMP + INTERVAL 6 HOUR > TIMESTAMP '2024-01-31 00:00:00' AS open
FROM (SELECT *, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY 1)""")
def provider_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of seven providers is held back after its last quota failure."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    a = e.select((F.col("user_id") % 7).alias("provider"), "ts", (F.col("event_type") == "purchase").alias("ok"), F.when(F.col("event_type") == "error", "quota").alias("category"))
    return state.circuit(a, "provider", "ts", "ok", "category", NOW).select("provider", "open")


