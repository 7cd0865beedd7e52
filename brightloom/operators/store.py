"""Versioned tables as a state store: keyed merge, atomic switch to a new version, and stages kept under a fingerprint of their inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from brightloom.operators.groups import first_rows


class Store:
    """Tables below a folder. A save writes a new version and then replaces the pointer, so that readers see the old or the new, never a part."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def version(self, name: str) -> str | None:
        """The current version's name: that of the newest pointer."""
        folder = self._path(f"{self.root}/{name}/current")
        if not self._fs().exists(folder):
            return None
        found = sorted(s.getPath().getName() for s in self._fs().listStatus(folder))
        return found[-1].partition("-")[2] if found else None

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return None if v is None else self.spark.read.parquet(f"{self.root}/{name}/data/{v}")

    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        v = uuid.uuid4().hex
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}/data/{v}")
        last = self._path(f"{self.root}/{name}/current")
        number = 1 + max([int(s.getPath().getName().partition("-")[0]) for s in self._fs().listStatus(last)] if self._fs().exists(last) else [0])
        self._fs().mkdirs(last)
        self._fs().create(self._path(f"{self.root}/{name}/current/{number:012d}-{v}"), False).close()

    def merge(self, name: str, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
        """Saves and gives the table with each key's first row in `order` of the old and new ones."""
        old = self.read(name)
        both = updates.withColumn("_new", F.lit(1)) if old is None else updates.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        self.save(name, first_rows(both, keys, [*order, -F.col("_new")]).drop("_new"))
        return self.read(name)


def _written(c: Column, kind: DataType) -> Column:
    """A struct, or an array of them, as text: fields parted by U+0002 and entries by U+0003, nulls as nothing."""
    if isinstance(kind, ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: _written(x, kind.elementType)), "\u0003"), F.lit(""))
    return F.concat_ws("\u0002", *[F.coalesce(c[f.name].cast("string"), F.lit("")) for f in kind.fields])


def fingerprint(evidence: DataFrame, by: list[str]) -> DataFrame:
    """A digest of each group's documents that doesn't depend on their order: texts, facts and metadata of each, by key.

    Documents are digested alone and the digests added up, 32 bits at a time, so that a group of any size is a sum."""
    told = lambda c: _written(F.col(c), evidence.schema[c].dataType)
    one = F.sha2(F.concat_ws("\u0001", "document_key", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256), told("structured_facts"), told("metadata")), 256)
    parts = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]
    sums = evidence.withColumn("_d", one).groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *parts)
    return sums.select(*by, "documents", F.sha2(F.concat_ws(",", "documents", *[f"s{i}" for i in range(8)]), 256).alias("fingerprint"))


def stages_to_run(wanted: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Stages of each key that must run: those not done, or done under another pipeline version or fingerprint. wanted: key, fingerprint, stage."""
    ok = done.where(F.col("pipeline_version") == version).select("key", "fingerprint", "stage").distinct()
    return wanted.join(ok, ["key", "fingerprint", "stage"], "left_anti")


def merge_parts(parts: DataFrame, key: str, seq: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Partial results as one: lists one after another with repeats removed, the first of them kept; of scalars, the first that isn't empty.

    Values of lists are made distinct on the map side before they are gathered, so that what a key holds in the end is its distinct values; a key without lists has an empty one."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(seq))).alias(c) for c in scalars]
    out = parts.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *first)
    for c in lists:
        each = parts.select(key, F.col(seq).alias("_s"), F.posexplode(c).alias("_p", "_v"))
        once = each.groupBy(key, "_v").agg(F.min(F.struct("_s", "_p")).alias("_at"))
        merged = once.groupBy(F.col(key).alias("_k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(c))
        kind = parts.schema[c].dataType
        out = out.join(merged, out[key].eqNullSafe(merged["_k"]), "left").drop("_k").withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return out.select(key, *scalars, *lists)
