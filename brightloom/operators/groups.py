"""Building blocks that hold for keys of any size: first rows, ranks and running positions without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.session import stored


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; pre-aggregated on the map side, so that a hot key is one row a task."""
    cols = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first k rows of each group with their place; each task keeps k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "position", parts: int | None = None) -> DataFrame:
    """df with each row's position from 1 in its group, by range partitions, so that a hot group is spread over many tasks.

    The slices of a group are sorted and counted apart; a slice's offset is the count of the slices before it. order must
    be unique in a group for positions to be the same in every run."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = stored(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))  # at most `parts` rows a group
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    rows = sliced.withColumn("_at", inner)
    same = F.col("a._slice") == F.col("b._slice")
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return rows.alias("a").join(offsets.alias("b"), same).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._at") + F.col("b._before")).cast("long").alias(name))
