"""Quantities in unlike units, brought to the common unit of their metric.

Every row is read into a number and the *spelling* of its unit. The distinct spellings, of which there are few, are
mapped to units through an inverted index of character n-grams that proposes vocabulary entries and a weighted edit
distance that verifies them; the resulting alias dictionary is joined to all rows. Arithmetic is exact decimal.

Defined cases: null, empty or unreadable columns give no quantity; a spelling that fits no unit of the metric's kind,
or two different units equally well, has no alias, and its row has no value; values beyond 30 whole digits give null, and those beyond a BIGINT no row;
an unknown or blank metric drops the row; repeated rows each come out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import quantity_text as qt
from brightloom.session import arrow, blank, small, spread, stored

#: aliases of more distinct spellings than this are joined by shuffle, not broadcast.
BROADCAST_ALIASES = 100_000

# Unit names by kind, with the common unit's factor as numerator and denominator.
_UNITS = {
    "per_share": [
        (1, 1, ["us cent per share", "cent per share", "cents per share", "cents a share", "cents/share", "c per share", "¢ per share", "¢ a share", "¢/share", "c/share", "cents", "¢", "c"]),
        (100, 1, ["usd per share", "usd a share", "usd/share", "usd /share", "usd/sh", "dollars per share", "dollars a share", "dollar per share", "$ per share", "$ a share", "$/share", "us$ per share", "$", "usd", "us$", "dollars", "us dollars"]),
    ],
    "ratio": [
        (1, 1, ["basis point", "basis points", "bp", "bps"]),
        (100, 1, ["%", "pct", "percent", "per cent", "percentage"]),
        (10, 1, ["‰", "per mille", "permille", "per mil"]),
        (10_000, 1, ["fraction", "fraction of", "ratio", "ratio of", "ratio (1 = all)", "share of", "proportion of"]),
    ],
    "power": [
        (1, 1000, ["w", "watts", "watt"]),
        (1, 1, ["kw", "kilowatts", "kilowatt"]),
        (1000, 1, ["mw", "megawatts", "megawatt"]),
        (10**6, 1, ["gw", "gigawatts", "gigawatt"]),
        (10**9, 1, ["tw", "terawatts", "terawatt"]),
    ],
    "storage": [
        (1, 10**6, ["mb", "mbyte", "megabytes", "megabyte"]),
        (1, 1000, ["gb", "gbyte", "gigabytes", "gigabyte"]),
        (1, 1, ["tb", "tbyte", "terabytes", "terabyte"]),
        (1000, 1, ["pb", "pbyte", "petabytes", "petabyte"]),
        (10**6, 1, ["eb", "ebyte", "exabytes", "exabyte"]),
        (10**9, 1, ["zb", "zettabytes", "zettabyte"]),
    ],
    "duration": [
        (1, 1440, ["min", "mins", "minutes"]),
        (1, 24, ["h", "hr", "hrs", "hour", "hours"]),
        (1, 1, ["d", "day", "days"]),
        (7, 1, ["w", "wk", "wks", "week", "weeks"]),
    ],
    "area": [
        (1, 1, ["square metre", "square metres", "square meter", "square meters", "sqm", "sq m", "m2"]),
        (10_000, 1, ["ha", "hectare", "hectares"]),
        (10**6, 1, ["square kilometres", "square kilometers", "sq km", "km2"]),
        (9_290_304, 10**8, ["square foot", "square feet", "sq ft", "sqft", "sf", "ft2"]),
        (40_468_564_224, 10**7, ["ac", "acre", "acres"]),
    ],
    "mass": [
        (1, 1000, ["g", "gram", "grams"]),
        (1, 1, ["kg", "kgs", "kilogram", "kilograms"]),
        (1000, 1, ["t", "ton", "tons", "tonne", "tonnes", "metric ton", "metric tons"]),
        (45_359_237, 10**8, ["lb", "lbs", "pound", "pounds"]),
    ],
    "pieces": [
        (12, 1, ["dz", "dozen", "dozens"]),
    ],
}
_SCALES = [(1, [""]), (1000, ["thousand", "thousands", "k", "000s", "000"]), (10**6, ["million", "millions", "m", "mn", "mm"]), (10**9, ["billion", "billions", "bn", "b"])]
_MONEY = ["$", "usd", "us$", "dollars", "us dollars"]
_PIECES = ["unit", "units", "pieces", "pcs", "piece"]
# end of fixed values


def vocabulary() -> list[tuple[str, str, int, int]]:
    """(kind, spelling, numerator, denominator); money and pieces are composed of scale words and base words by rule."""
    out: dict[tuple[str, str], tuple[int, int]] = {}
    for kind, units in _UNITS.items():
        for num, den, names in units:
            for name in names:
                out[kind, qt.fold(name)] = (num, den)
    for factor, words in _SCALES:
        for s in words:
            for base in _MONEY:
                for form in (f"{base} {s}", f"{s} {base}", *([f"{base} in {s}", f"{base}, amounts in {s}"] if s else [])):
                    out["money", qt.fold(form)] = (factor, 1)
            if s:
                out["money", f"in {s}"] = out["money", f"amounts in {s}"] = (factor, 1)
                out["money", f"in {s}, except per share data"] = (factor, 1)
                out["per_share", f"in {s}, except per share data"] = (100, 1)
            for base in _PIECES:
                out["pieces", qt.fold(f"{s} {base}")] = (factor, 1)
    return [(k, n, *v) for (k, n), v in out.items()]


def squeeze(spelling: str) -> str:
    """The part of a spelling that n-grams are taken of: without blanks and marks that carry no meaning."""
    return "".join(c for c in spelling if c not in " .,:;'’\"()=-_")


def grams(spelling: str, n: int = 2) -> list[str]:
    s = f"^{squeeze(spelling)}|"
    return sorted({s[i : i + n] for i in range(max(1, len(s) - n + 1))})


#: weights: marks and blanks hardly count, a plural ending little; a change of a first letter, where k, m and b stand, counts double.
_CHEAP = set(" .,:;'’\"()=-_")


def _drops(s: str) -> list[float]:
    """What each letter of a spelling costs to leave out."""
    out = []
    for i, c in enumerate(s):
        if c in _CHEAP:
            out.append(0.02)
        elif c == "s" and i == len(s) - 1 and len(s) > 3:
            out.append(0.1)
        else:
            out.append(2.0 if i == 0 or s[i - 1] in _CHEAP or c in "0123456789%‰$¢/" else 1.0)
    return out


def edit_cost(a: str, b: str, limit: float = float("inf")) -> float:
    """Weighted edit distance of two spellings; infinite as soon as it must be over the limit."""
    da, db = _drops(a), _drops(b)
    row = [0.0]
    for d in db:
        row.append(row[-1] + d)
    for i, x in enumerate(a):
        out = da[i]
        new = [row[0] + out]
        for j, y in enumerate(db):
            swap = 0.0 if x == b[j] else max(out, y) + (0.5 if i == 0 or j == 0 else 0)
            new.append(min(row[j] + swap, row[j + 1] + out, new[j] + y))
        if min(new) > limit:
            return float("inf")
        row = new
    return row[-1]


def allowed_cost(spelling: str) -> float:
    """Short spellings must fit but for marks and a plural; longer ones may have a slip for every six letters."""
    return 0.3 + len(squeeze(spelling)) // 6


def _rows_of(number, unit) -> tuple[str | None, str | None]:
    return (format(number, "f"), unit) if number is not None else (None, None)


@arrow("col_number string, col_unit string, quote_number string, quote_unit string")
def _read(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for metric, value_num, value_text, unit, quote in parts:
        out = []
        for m, n, t, u, q in zip(metric, value_num, value_text, unit, quote):
            own = qt.fold(u) if isinstance(u, str) else ""
            number = spelling = None
            if n is not None and n == n:
                number, spelling = Decimal(repr(float(n))), own
            elif isinstance(t, str) and (got := qt.read(t)):
                number, spelling = got[0], got[1] or own
            try:
                col = _rows_of(number, spelling)
            except (InvalidOperation, ValueError):
                col = (None, None)
            got = qt.read_quote(q, m) if isinstance(q, str) else None
            out.append((*col, *(_rows_of(*got) if got else (None, None))))
        yield pd.DataFrame(out, columns=["col_number", "col_unit", "quote_number", "quote_unit"])


def read_quantities(cards: DataFrame, catalog: DataFrame, key: str = "card_seq") -> DataFrame:
    """Every card of a known metric with the numbers and unit spellings of its columns and of its quote."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", " "))
    kinds = catalog.select(fold("metric").alias("_m"), F.col("quantity_kind").alias("kind"), "common_unit")
    kinds = kinds.where("_m <> ''").groupBy("_m").agg(F.min(F.struct("kind", "common_unit")).alias("k")).select("_m", "k.*")  # of a metric listed twice, the same in every run
    rows = cards.select(F.col(key).alias("_key"), "metric", "value_num", "value_text", "unit", "quote").where(~blank("metric")).withColumn("_m", fold("metric"))
    quote = F.when(F.col("quote").rlike(qt.SOME_NUMBER), F.col("quote"))  # a quote without a digit or a number word holds no quantity, and needn't leave the JVM
    return spread(rows).join(kinds, "_m").select("_key", "kind", "common_unit", "value_num", "unit", _read("metric", "value_num", "value_text", "unit", quote).alias("r")).select("*", "r.*").drop("r")


@arrow("double")
def _cost(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_cost(x, y, allowed_cost(x)) for x, y in zip(a, b)], dtype="float64")


@arrow("double")
def _allowed(a: pd.Series) -> pd.Series:
    return a.map(allowed_cost)


@arrow("array<string>")
def _grams(a: pd.Series) -> pd.Series:
    return a.map(lambda s: grams(s) if isinstance(s, str) else [])


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(kind, spelling, num, den) of every distinct (kind, spelling) that fits one unit of its kind."""
    spark: SparkSession = spellings.sparkSession
    index = F.broadcast(  # constant of this module: a few hundred entries
        spark.createDataFrame([(k, n, num, den, g) for k, n, num, den in vocabulary() for g in grams(n)], "kind string, name string, num long, den long, gram string")
    )
    asked = spellings.where(F.col("spelling") != "").distinct().withColumn("g", _grams("spelling"))
    shared = asked.withColumn("n_grams", F.size("g")).withColumn("gram", F.explode("g")).drop("g").join(index, ["kind", "gram"])
    candidates = shared.groupBy("kind", "spelling", "n_grams", "name", "num", "den").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") * 2 >= F.col("n_grams") - 1)
    verified = candidates.repartition(spark.sparkContext.defaultParallelism).withColumn("cost", _cost("spelling", "name")).where(F.col("cost") <= _allowed("spelling"))
    by_unit = verified.groupBy("kind", "spelling", "num", "den").agg(F.min("cost").alias("cost"))
    best = by_unit.groupBy("kind", "spelling").agg(F.sort_array(F.collect_list(F.struct("cost", "num", "den"))).alias("fits"))  # at most one entry a unit of the vocabulary
    clear = (F.size("fits") == 1) | (F.expr("try_element_at(fits, 2).cost") - F.col("fits")[0]["cost"] >= 0.25)
    return best.where(clear).select("kind", "spelling", F.col("fits")[0]["num"].alias("num"), F.col("fits")[0]["den"].alias("den"))


#: numbers that a DECIMAL(22,8) holds exactly, and built-in arithmetic with it; others go through Python.
SHORT = r"^-?\d{1,14}(\.\d{1,8})?$"


def exact_value(number: str, num: int, den: int) -> Decimal | None:
    """number * num / den, rounded half away from zero; None beyond 30 whole digits."""
    d = Decimal(number)
    if not d.is_finite() or d.adjusted() > 40:
        return None
    with localcontext(prec=len(number) + 60):
        whole, rest = divmod(abs(d) * num, den)
        whole += 2 * rest >= den
        return (-whole if d < 0 else whole) if whole < 10**30 else None


@arrow("decimal(38,8)")
def _exact(number: pd.Series, num: pd.Series, den: pd.Series) -> pd.Series:
    out = [exact_value(s, int(n), int(d)) if isinstance(s, str) and n == n and n is not None else None for s, n, d in zip(number, num, den)]
    return pd.Series(out, dtype="object")


def normalise(cards: DataFrame, catalog: DataFrame, key: str = "card_seq") -> DataFrame:
    """(key, common_unit, common_value, stated): every card's current quantity in the common unit of its metric.

    The quote's reading is preferred, since it is right where the two disagree in scale; stated tells that value_num
    with unit equal to common_unit already says that value. common_value is rounded half away from zero."""
    read = stored(read_quantities(cards, catalog, key), "quantities")
    asked = read.select("kind", F.explode(F.array("col_unit", "quote_unit")).alias("spelling")).where(F.col("spelling").isNotNull())
    aliases = stored(alias_dictionary(asked), "unit_aliases")
    n = aliases.count()

    def joined(df: DataFrame, side: str) -> DataFrame:
        a = small(aliases.select(F.col("kind"), F.col("spelling").alias(f"{side}_unit"), F.col("num").alias(f"{side}_n"), F.col("den").alias(f"{side}_d")), BROADCAST_ALIASES, n)
        return df.join(a, ["kind", f"{side}_unit"], "left")

    def valued(side: str) -> Column:
        number, num, den = (F.col(f"{side}_{x}") for x in ("number", "n", "d"))
        short = F.expr(f"try_divide(try_cast({side}_number AS DECIMAL(22,8)) * CAST({side}_n AS DECIMAL(15,0)), CAST({side}_d AS DECIMAL(9,0)))")
        return F.when(number.rlike(SHORT), short).otherwise(_exact(F.when(~number.rlike(SHORT), number), num, den))

    both = joined(joined(read, "col"), "quote").withColumns({"col_value": valued("col"), "quote_value": valued("quote")})
    value = F.round(F.coalesce("quote_value", "col_value"), 0).try_cast("long")
    said = (F.col("value_num").isNotNull()) & (F.col("unit") == F.col("common_unit"))
    out = both.select(F.col("_key").alias(key), "common_unit", value.alias("common_value"), F.coalesce(said & (F.round("col_value", 0).try_cast("long") == value), F.lit(False)).alias("stated"), "quote_value", "col_value")
    return out.where(F.col("common_value").isNotNull())
