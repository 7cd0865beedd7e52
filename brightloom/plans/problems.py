"""Queries of the training-data problems that are of general use: units and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import instants, units
from brightloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose current quantity can be read and isn't already stated in the common unit."""
    values = units.normalise(table(spark, sf_dir, "cards"), table(spark, sf_dir, "metric_catalog"))
    return values.where(~F.col("stated")).select("card_seq", "common_unit", "common_value")


def dated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "disclosures").select(F.lit("disclosure").alias("record_kind"), F.col("disclosure_seq").alias("record_id"), "source", F.col("published_at").alias("text"))
    e = table(spark, sf_dir, "earnings_events").select(F.lit("event"), "event_row", "first_seen_source", "first_seen_at")
    return d.unionAll(e)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text names a real date or instant, in UTC."""
    got = instants.normalise(dated_records(spark, sf_dir), table(spark, sf_dir, "source_profile"), ["record_kind", "record_id"])
    return got.select("record_kind", "record_id", "utc_us")


def p4_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each source were read directly, as a first pass of a repeated hour, or in a skipped hour."""
    records = dated_records(spark, sf_dir)
    got = instants.normalise(records, table(spark, sf_dir, "source_profile"), ["record_kind", "record_id", "source"])
    return got.groupBy("record_kind", "source", "reading").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_readings": p4_readings}
SQL: dict[str, str] = {}
