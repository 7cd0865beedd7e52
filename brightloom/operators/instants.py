"""Timestamps in mixed forms, precisions and zones, brought to one UTC instant.

Texts are read with built-in expressions into a local time and a zone. Where the zone is a region, local times are
joined to zone-offset intervals exploded to one row for each zone and month that occurs: two intervals that hold the
local time mean an ambiguous one (the first pass counts), none means that it was skipped (the offset before the change
counts), one gives the offset. The interval rows are made for the distinct pairs of zone and month only.

Defined cases: null, blank, unreadable and impossible texts (30 February, 00:61, hour 13 with p.m.) give no row; so do
unknown zone names, and texts without a zone whose source has no profile; repeated rows each come out; an empty table
gives an empty result; fractions beyond microseconds are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.session import small, stored

#: with more pairs of zone and month than this, the intervals are joined by shuffle, not broadcast.
BROADCAST_INTERVALS = 50_000

# Abbreviations with one offset (minutes), general names with a region's civil time, month names.
_FIXED = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660,
}
_REGIONS = {
    "ET": "America/New_York", "EASTERN TIME": "America/New_York", "CT": "America/Chicago", "CENTRAL TIME": "America/Chicago",
    "MT": "America/Denver", "MOUNTAIN TIME": "America/Denver", "PT": "America/Los_Angeles", "PACIFIC TIME": "America/Los_Angeles",
    "LONDON TIME": "Europe/London", "UK TIME": "Europe/London", "TOKYO TIME": "Asia/Tokyo", "JAPAN TIME": "Asia/Tokyo",
    "SYDNEY TIME": "Australia/Sydney", "INDIA TIME": "Asia/Kolkata",
}
_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
# end of fixed values

_NAMED = r"^(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEP(?:T|TEMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)$"
_DATES = {  # form: (pattern, groups of year, month, day; None: by the source's order)
    "year": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "$1|$2|$3"),
    "kanji": (r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", "$1|$2|$3"),
    "packed": (r"(\d{4})(\d{2})(\d{2})", "$1|$2|$3"),
    "numeric": (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", None),
    "month": (r"(?:[A-Z]{3,9}\.?,?\s+)?([A-Z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})", "$3|$1|$2"),
    "day": (r"(?:[A-Z]{3,9}\.?,?\s+)?(\d{1,2})\s+([A-Z]{3,9})\.?,?\s+(\d{4})", "$3|$2|$1"),
}
#: after a date: nothing, or a time with any precision and half of the day; then a zone, seven groups in all.
_TIME = r"(?:(?:\s*[T,]\s*|\s+AT\s+|\s+-\s+|\s*)(\d{1,2})[:時]?(\d{2})分?(?::?(\d{2})秒?(?:[.,](\d{1,9}))?)?(?:\s*([AP])\.?M\.?(?![A-Z.]))?(?![\d:]))?"
_ZONE = r"\s*[\[(]?((?:(?:UTC|GMT)?\s*[+-]\d{1,2}:?(?:\d{2})?)|[A-Z][A-Z_ /+-]*[A-Z]|Z)?[\])]?\s*$"
_OFFSET = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2}?):?(\d{2})?$"


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def parse(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Adds local_us (microseconds of the local time as if it were UTC), offset_min, region (one of the two, or neither), zoned and epoch_us.

    Each form rewrites the text to year|month|day|hour|minute|second|fraction|half|zone in one pass.
    order: a column with the source's order of purely numeric dates, MDY, DMY or YMD (the last read as MDY where the year comes last)."""
    rows = rows.withColumn("_t", F.upper(F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))))
    parts = F.lit(None).cast("string")
    for pattern, groups in reversed(_DATES.values()):
        full, time = f"^{pattern}{_TIME}{_ZONE}", "$4|$5|$6|$7|$8|$9"
        if groups is None:
            rewritten = F.when(F.col(order) == "DMY", F.regexp_replace("_t", full, f"$3|$2|$1|{time}")).otherwise(F.regexp_replace("_t", full, f"$3|$1|$2|{time}"))
        else:
            rewritten = F.regexp_replace("_t", full, f"{groups}|{time}")
        parts = F.when(F.col("_t").rlike(full), rewritten).otherwise(parts)
    is_count = F.col("_t").rlike(r"^(?:\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})$")
    df = rows.withColumn("_p", F.when(~is_count, F.split(parts, r"\|"))).withColumn("_count", F.when(is_count, F.expr("try_cast(_t AS DECIMAL(19,0))")))
    digits = F.length("_t")
    epoch = F.floor(F.when(digits <= 10, F.col("_count") * 1_000_000).when(digits <= 13, F.col("_count") * 1000).when(digits <= 16, F.col("_count")).otherwise(F.col("_count") / 1000)).cast("long")
    at = lambda i, t="INT": F.expr(f"try_cast(nullif(_p[{i}], '') AS {t})")
    names = {m: i + 1 for i, m in enumerate(_MONTHS)}
    month = F.coalesce(at(1), F.when(F.col("_p")[1].rlike(_NAMED), _lookup(names, F.substring(F.col("_p")[1], 1, 3))))
    df = df.select("*", epoch.alias("epoch_us"), month.alias("_mo"), at(0).alias("_y"), at(2).alias("_d"), at(3).alias("_h"), F.coalesce(at(4), F.lit(0)).alias("_mi"), F.coalesce(at(5), F.lit(0)).alias("_s"),
        F.expr("coalesce(try_cast(rpad(substr(nullif(_p[6], ''), 1, 6), 6, '0') AS BIGINT), 0L)").alias("_us"), F.expr("nullif(_p[7], '')").alias("_half"), F.trim(F.col("_p")[8]).alias("_z"))
    hour = F.when(F.col("_h").isNull(), 0).when(F.col("_half").isNull(), F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_half") == "P", 12).otherwise(0))
    day = F.expr("unix_date(try_to_date(format_string('%04d-%02d-%02d', _y, _mo, _d), 'yyyy-MM-dd')) * 86400000000L")
    real = (F.col("_hour") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60)
    sign, hh, mm = (F.regexp_extract("_z", _OFFSET, g) for g in (1, 2, 3))
    offset = F.when(F.col("_z").rlike(_OFFSET), F.when(sign == "-", -1).otherwise(1) * (hh.try_cast("int") * 60 + F.coalesce(F.nullif(mm, F.lit("")).try_cast("int"), F.lit(0)))).otherwise(_lookup(_FIXED, F.col("_z")))
    region = F.coalesce(_lookup(_REGIONS, F.col("_z")), F.when(F.col("_z").rlike(r"^[A-Z_]+/[A-Z_+/-]+$"), F.col("_z")))
    df = df.select("*", hour.alias("_hour"), day.alias("_day"), offset.alias("offset_min"), region.alias("region"), (F.col("_z") != "").alias("zoned"))
    known = ~F.col("zoned") | F.col("offset_min").isNotNull() | F.col("region").isNotNull()
    local = F.when(real & known, F.col("_day") + ((F.col("_hour").cast("long") * 60 + F.col("_mi")) * 60 + F.col("_s")) * 1_000_000 + F.col("_us"))
    return df.withColumn("local_us", local).drop("_t", "_p", "_count", "_mo", "_y", "_d", "_h", "_mi", "_s", "_us", "_half", "_z", "_hour", "_day")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FAR = 10**18
_FIRST_S, _LAST_S = (round((datetime(*d, tzinfo=timezone.utc) - _EPOCH).total_seconds()) for d in ((1, 1, 3), (9999, 12, 29)))


def intervals(zone: str, month: int) -> list[tuple[int, int, int]] | None:
    """(local from, local to, offset) in microseconds, in the order of time, of all offset intervals near a month (months since year 0)."""
    import zoneinfo

    try:
        z = ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        known = {k.upper(): k for k in zoneinfo.available_timezones()}
        if zone.upper() not in known:
            return None
        z = ZoneInfo(known[zone.upper()])

    def offset(s: int) -> int:
        s = min(max(s, _FIRST_S), _LAST_S)  # datetime has no more years
        return round((_EPOCH + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())

    y, m = divmod(month, 12)
    start = round((datetime(y, m + 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    days = [start + d * 86_400 for d in range(-3, 36)]
    out, since = [], -_FAR
    for a, b in zip(days, days[1:]):
        if (before := offset(a)) != offset(b):
            lo, hi = a, b
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == before else (lo, mid)
            out.append((since if since == -_FAR else since + before * 10**6, (hi + before) * 10**6, before * 10**6))
            since = hi * 10**6
    last = offset(days[-1])
    return [*out, (since if since == -_FAR else since + last * 10**6, _FAR, last * 10**6)]


def _intervals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        got = [intervals(z, int(m)) for z, m in zip(pdf["region"], pdf["month"])]
        yield pd.DataFrame({"region": pdf["region"], "month": pdf["month"], "spans": [None if g is None else [{"lo": a, "hi": b, "off": c} for a, b, c in g] for g in got]})


def to_utc(parsed: DataFrame, key: list[str]) -> DataFrame:
    """key columns, utc_us and reading (exact, first_pass or skipped) of rows with local_us, offset_min, region and epoch_us."""
    day = "date_from_unix_date(CAST(floor(local_us / 86400000000D) AS INT))"
    month = F.expr(f"CAST(year({day}) * 12 + month({day}) - 1 AS INT)")
    rows = parsed.withColumn("region", F.when(F.col("offset_min").isNull() & F.col("epoch_us").isNull(), F.col("region"))).withColumn("month", F.when(F.col("region").isNotNull(), month))
    pairs = rows.select("region", "month").where(F.col("month").isNotNull()).distinct()
    spans = stored(pairs.mapInPandas(_intervals, "region string, month int, spans array<struct<lo: bigint, hi: bigint, off: bigint>>"), "intervals")
    joined = rows.join(small(spans, BROADCAST_INTERVALS), ["region", "month"], "left")
    joined = joined.withColumn("_in", F.expr("filter(spans, s -> s.lo <= local_us AND local_us < s.hi)"))
    before = F.expr("element_at(filter(spans, s -> s.hi <= local_us), -1).off")
    offset = F.when(F.size("_in") > 0, F.col("_in")[0]["off"]).otherwise(before)
    utc = F.coalesce("epoch_us", F.col("local_us") - F.coalesce(F.col("offset_min").cast("long") * 60_000_000, offset))
    reading = F.when(F.size("_in") == 2, "first_pass").when(F.size("_in") == 0, "skipped").otherwise("exact")
    return joined.select(*key, utc.alias("utc_us"), reading.alias("reading")).where(F.col("utc_us").isNotNull())


def normalise(records: DataFrame, profile: DataFrame, key: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """key, utc_us and reading of every record whose text names a real date or instant; a text without a zone has its source's default zone."""
    p = profile.select(F.col("source").alias("_source"), F.col("default_zone").alias("_home"), F.col("date_order").alias("_order"))
    p = p.groupBy("_source").agg(F.min(F.struct("_home", "_order")).alias("p")).select("_source", "p.*")
    rows = records.select(*key, F.col(text).alias("_text"), F.col(source).alias("_source")).where(F.col("_text").rlike(r"\d")).join(p, "_source", "left")
    parsed = parse(rows, "_text", "_order").withColumn("region", F.coalesce("region", F.when(~F.col("zoned"), F.col("_home"))))
    return to_utc(stored(parsed.select(*key, "epoch_us", "local_us", "offset_min", "region"), "instants"), key)
