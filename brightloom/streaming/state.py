"""Structured Streaming: ingest without repeats, event state with timers, windows over late data, circuit state, idempotent sinks.

Each transform takes a DataFrame, so that the same code runs on a table and on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brightloom.session import shared_dir


#: how long an event's documents are waited for.
QUIET_MS = 4 * 3600 * 1000


def read(spark: SparkSession, path: str, like: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file by its name, as a stream with a known schema."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(like.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def timed(df: DataFrame, at: str, late: str) -> DataFrame:
    """df with its event time as an instant (a time without a zone is read in the session's), and a watermark if it is a stream."""
    if df.schema[at].dataType.simpleString() == "timestamp_ntz":
        df = df.withColumn(at, F.col(at).cast("timestamp"))
    return df.withWatermark(at, late) if df.isStreaming else df


def without_repeats(df: DataFrame, keys: list[str], at: str, late: str = "2 days") -> DataFrame:
    """Each key once; state is kept for as long as rows may be late."""
    return timed(df, at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def windowed(df: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows, final once the watermark has passed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    src = timed(df, at, late)
    out = src.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: spans without a pause of `gap`."""
    src = timed(df, at, late)
    out = src.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    """Documents of an event so far; a row each time that new ones come, versioned, and one when nothing came for the waiting time."""
    if state.hasTimedOut:
        version, seen, _ = state.get
        yield pd.DataFrame({"event_id": [key[0]], "version": [version], "documents": [seen], "cause": ["quiet"]})
        state.remove()
        return
    version, seen, digest = state.get if state.exists else (0, 0, "")
    known = set(filter(None, digest.split("\n")))
    new = sorted({d for p in parts for d in p["document_key"].dropna()} - known)
    if new:
        known.update(new)
        version, seen = version + 1, len(known)
        yield pd.DataFrame({"event_id": [key[0]], "version": [version], "documents": [seen], "cause": ["new" if version == 1 else "late"]})
    state.update((version, seen, "\n".join(sorted(known))))


def _follow_timed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
    timed_out = state.hasTimedOut
    yield from _follow(key, parts, state)
    if not timed_out:
        state.setTimeoutDuration(QUIET_MS)


def follow_events(documents: DataFrame, wait: bool = False) -> DataFrame:
    """(event_id, version, documents, cause) whenever an event's documents grow; late ones open a new version. documents: event_id, document_key.

    wait: also tells of events to which nothing came for the waiting time; such a stream has no end, also when only what is there now is read.

    An event's documents are some dozens; rows without an event are dropped before, so that no key is hot."""
    return documents.where("event_id IS NOT NULL").select("event_id", "document_key").groupBy("event_id").applyInPandasWithState(
        _follow_timed if wait else _follow, "event_id string, version int, documents int, cause string", "version int, documents int, digest string", "update",
        GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout,
    )


def circuit(attempts: DataFrame, provider: str, at: str, ok: str, category: str, now: datetime | None, hours: int = 6) -> DataFrame:
    """Each provider's last deciding attempt: a success closes the circuit, a quota failure opens it for some hours, other failures decide nothing."""
    last = attempts.where(F.col(ok) | (F.col(category) == "quota")).groupBy(provider).agg(F.max_by(F.struct(ok, at), F.struct(at, F.col(ok).cast("int"))).alias("a"))
    until = F.when(~F.col(f"a.{ok}"), F.col(f"a.{at}") + F.expr(f"INTERVAL {hours} HOURS"))
    clock = F.lit(now) if now else F.current_timestamp()
    return last.select(provider, until.alias("blocked_until"), F.coalesce(until > clock, F.lit(False)).alias("open"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append", most_s: int = 540) -> DataFrame:
    """Runs a stream over what is there now and gives its rows; for tests and batch-like use. One that takes longer is stopped, with an error."""
    spark = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        _end(q, most_s)
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    table = f"t_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/{table}/batch={number}")  # the same batch again replaces itself

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    _end(q, most_s)
    return spark.read.option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").drop("batch")


def _end(q, most_s: int) -> None:
    if not q.awaitTermination(most_s):
        q.stop()
        raise TimeoutError(f"the stream took more than {most_s} seconds")
