"""Copies of records that differ only in how they are written, found by progressive refinement of a partition.

First all records fall into classes by cheap invariants: how often the commonest letters, and digits, occur in them. These
are the same for any order of fields, case, white space and punctuation. Only members of classes with several members
get the costlier key, a digest of the fields' full canonical form, and are grouped by it. Counting is
pre-aggregated on the map side, so that a group of copies of any size is no hot key.

Canonical form: lower case; white space and punctuation are dropped, but a point before a digit (not after a letter)
and a minus before a digit (not after a letter or digit) stay, and so do percent, per mille and currency signs.

Defined cases: null and empty fields are equal; records whose fields are all blank are copies of each other; the
operator has no limit on text length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.session import spread, stored

#: classes with several members are broadcast (8 bytes each) up to this many; beyond, the heaviest are, and the rest joins by shuffle.
BROADCAST_CLASSES = 1_000_000
#: a class with more than this share of all records is heavy; there are at most 1 / share of them.
HEAVY_SHARE = 1 / 500

_DROP = r"[\p{P}\p{Z}\p{Cf}\s|`^~´¨&&[^%‰‱]]+"
# the marks themselves come first in these patterns, so that other characters are passed over at once
_MINUS = r"[-−‐‑‒–﹣－](?<![\p{L}\p{N}].)(?=\p{Sc}?\.?\d)"
_POINT = r"\.(?<![\p{L}.]\.)(?=\d)"


def canonical(c: Column | str) -> Column:
    """The form in which copies are equal; "\\u0001" stands for a minus and "\\u0002" for a decimal point."""
    s = F.lower(F.upper(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _MINUS, "\u0001"), _POINT, "\u0002"), _DROP, "")


#: the letters and digits of the histogram: the commonest letters, and digits, as records with the same words mostly differ in their figures.
_BINS = list("eta0123456")


def cheap_class(kind: str, fields: list[str]) -> Column:
    """A 64-bit number of the cheap invariants of a record: counts by byte search, without patterns."""
    s = F.lower(F.upper(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])))
    count = lambda x, b: F.length(x) - F.length(F.replace(x, F.lit(b), F.lit("")))
    return F.transform(F.array(s), lambda x: F.xxhash64(F.col(kind), *[count(x, b) for b in _BINS]))[0]


def digest(fields: list[str]) -> Column:
    """128 bits of the canonical fields in their own order; collisions are out of reach of any real corpus."""
    return F.unhex(F.md5(F.concat_ws("\u0003", *[canonical(f) for f in fields])))


def in_shared_classes(records: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """The records in classes of several members, with their class in _class."""
    classed = spread(records).withColumn("_class", cheap_class(kind, fields))
    classes = stored(classed.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "classes")
    n, total = classes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if n <= BROADCAST_CLASSES:
        return classed.join(F.broadcast(classes.select("_class")), "_class", "left_semi")
    heavy = F.broadcast(classes.where(F.col("_n") > int(total * HEAVY_SHARE)).select("_class"))  # at most 1 / HEAVY_SHARE rows
    light = classed.join(heavy, "_class", "left_anti").join(classes.select("_class"), "_class", "left_semi")
    return classed.join(heavy, "_class", "left_semi").unionByName(light)


def members(records: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Records that may have copies, with _key: equal keys within a kind are copies."""
    return in_shared_classes(records, kind, fields).withColumn("_key", digest(fields)).drop("_class")


def groups(records: DataFrame, kind: str, key: str, fields: list[str]) -> DataFrame:
    """(kind, first_id, copies) of every group of two records or more with equal canonical fields."""
    found = members(records.select(kind, key, *fields), kind, fields)
    counted = found.groupBy(kind, "_key").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).cast("int").alias("copies"))
    return counted.where("copies > 1").select(kind, "first_id", "copies")


def collapse(records: DataFrame, kind: str, key: str, fields: list[str]) -> DataFrame:
    """(kind, first_id, copies) of every record that stays: one a group, singles with one copy."""
    rows = records.select(kind, key, *fields)
    found = stored(members(rows, kind, fields).select(kind, key, "_key"), "copies")
    counted = found.groupBy(kind, "_key").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).cast("int").alias("copies")).select(kind, "first_id", "copies")
    single = rows.select(kind, key).join(found.select(kind, key), [kind, key], "left_anti").select(kind, F.col(key).alias("first_id"), F.lit(1).alias("copies"))
    return counted.unionByName(single)


_FIELD = "(?:statement|metric|period)"


def feed_fields(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """feed with statement, metric and period read from its payload: JSON, "key=value | key=value" or "Key: value" lines.

    Field names may be in any case; a payload in none of these notations gives three nulls."""
    p = F.trim(F.col(payload))
    as_map = F.when(p.startswith("{"), F.from_json(p, "map<string,string>", {"mode": "PERMISSIVE"}))
    as_map = F.when(as_map.isNotNull(), F.map_from_entries(F.transform(F.map_entries(as_map), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))))
    df = feed.withColumn("_map", as_map)

    def field(name: str) -> Column:
        pairs = F.regexp_extract(payload, rf"(?is)(?:^|\|)\s*{name}\s*=(.*?)(?:\|\s*{_FIELD}\s*=|$)", 1)
        lines = F.regexp_extract(payload, rf"(?is)(?:^|\n)[ \t]*{name}[ \t]*:(.*?)(?:\n[ \t]*{_FIELD}[ \t]*:|$)", 1)
        in_pairs = F.col(payload).rlike(rf"(?i)^\s*{_FIELD}\s*=")
        return F.when(F.col("_map").isNotNull(), F.element_at("_map", name)).when(in_pairs, pairs).otherwise(lines)

    return df.select("*", *[field(n).alias(n) for n in ("statement", "metric", "period")]).drop("_map")
