"""What every operator needs of a session: reading tables, shipping this package, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_stored: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once in an application, so that Arrow functions can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="brightloom-")) / "brightloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: spark.checkpoint.dir of the session. Only where it is unset and all runs on this machine, as in tests, it is a local one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/brightloom-{os.getuid()}-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, and the table outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(jvm, conf) -> int:
    n = 0
    while _stored:
        p = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


def drop_stored(spark: SparkSession) -> int:
    """Removes the tables that this process has stored; results that read them must have been computed. Gives their number.

    What is left when the process ends is removed then: until then, results that are lazy may read it."""
    return _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())


@atexit.register
def _drop_at_exit() -> None:
    gateway = SparkContext._gateway
    if _stored and gateway is not None:
        try:
            _delete(gateway.jvm, gateway.jvm.org.apache.hadoop.conf.Configuration())
        except Exception:  # noqa: BLE001 - the JVM may be gone, and nothing depends on this
            _stored.clear()


#: what is estimated to be larger than this is never shuffled only to spread it: it has row groups enough.
MOST_SPREAD_BYTES = 4 << 30


def _has_exchange(plan) -> bool:
    """Whether a physical plan moves rows between tasks."""
    if plan.nodeName().endswith("Exchange") or plan.nodeName().endswith("ExchangeExec") or plan.nodeName() == "AdaptiveSparkPlan":
        return True
    children = plan.children()
    return any(_has_exchange(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly work on its rows, where its scan has fewer partitions than there are cores; larger tables, and what is shuffled or joined before, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if _has_exchange(plan):  # to count its partitions would be to run it
        return df
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) > MOST_SPREAD_BYTES:
        return df
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def map_rows(df: DataFrame, keep: list[str], content: list[Column], run, schema: str) -> DataFrame:
    """Rows through Python in batches: run gets frames of the keep columns as texts, and of the content columns, and gives frames with the keep columns and those of schema.

    Kept columns travel as texts and get their own types back, since whole numbers beside nulls would become floats on the way."""
    kinds = {c: df.schema[c].dataType for c in keep}
    asked = spread(df.select(*[F.col(c).cast("string").alias(c) for c in keep], *content))
    out = asked.mapInPandas(run, ", ".join([*(f"`{c}` string" for c in keep), schema]))
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], *[c for c in out.columns if c not in keep])


def small(df: DataFrame, most_rows: int, count: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has most_rows rows at most; else unchanged, and the join shuffles. Without a count given, df is stored before, so that it isn't computed twice."""
    return F.broadcast(df) if (df.count() if count is None else count) <= most_rows else df


def blank(c: Column | str) -> Column:
    """True for null and for texts of white space only."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", "")), F.lit("")) == ""


def arrow(returns: str):
    """Like pandas_udf, but made at the first call, so that modules can be imported where there is no session."""

    def wrap(f):
        made = []

        def call(*columns):
            if not made:
                made.append(F.pandas_udf(f, returns))
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
