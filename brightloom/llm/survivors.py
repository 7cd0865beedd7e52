"""One surviving record for each group of copies, chosen and built field by field.

A single aggregation takes, for every attribute, the greatest composite of (has a valid value, rank of the record,
value), where the rank is the source's trust, completeness, time and key. It is pre-aggregated on the map side, so a
group may hold any share of all rows.

Defined cases: a record without a source profile ranks below any with one; null times rank last; among equal records
the smallest key wins; an attribute without a valid value in its group is null; repeated rows count as copies; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm import duplicates


def survive(rows: DataFrame, group: list[str], key: str, rank: list[Column], attributes: dict[str, tuple[Column, Column]], whole: dict[str, Column]) -> DataFrame:
    """One row a group: first_id, copies, survivor_id, the whole columns of the highest ranked record, and every attribute's best value.

    rank: high first; then the smallest key. attributes: name -> (value, whether it is valid)."""
    order = [*[r.alias(f"r{i}") for i, r in enumerate(rank)], (-F.col(key)).alias("k")]
    best = F.max(F.struct(*order, *[c.alias(n) for n, c in whole.items()])).alias("_best")
    fields = [F.max(F.struct(valid.alias("ok"), *order, value.alias("v"))).alias(f"_{n}") for n, (value, valid) in attributes.items()]
    out = rows.groupBy(*group).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).cast("int").alias("copies"), best, *fields)
    picked = [F.when(F.col(f"_{n}")["ok"], F.col(f"_{n}")["v"]).alias(n) for n in attributes]
    return out.select("first_id", "copies", (-F.col("_best")["k"]).alias("survivor_id"), *[F.col("_best")[n].alias(n) for n in whole], *picked)


#: attributes of a card that are built field by field, beside the source and materiality.
FIELDS = ["card_type", "topic", "fact_class", "value_num", "value_text", "unit", "low", "midpoint", "high", "reported_change", "speaker", "analyst", "management_speaker", "question_summary", "answer_summary", "metric_type", "guidance_type"]


def best_cards(cards: DataFrame, profile: DataFrame, fields: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The survivor of each group of copies among cards: (first_id, copies, survivor_id, source, materiality_candidate, fields).

    A card's source is that of the disclosure that its document_key names; its own source column may be wrong. Of each of fields, the first value
    in the order of rank that is neither null nor an empty text survives."""
    parts = ["card_seq", "statement", "metric", "period", "document_key", "unit", "low", "midpoint", "high", "reported_change", "materiality_candidate", "extracted_at"]
    parts += [f for f in fields if f not in parts]
    records = cards.select(F.lit("card").alias("record_kind"), *parts)
    found = duplicates.members(records, "record_kind", ["statement", "metric", "period"])
    trust = profile.groupBy(F.col("source").alias("_source")).agg(F.max("trust_score").alias("_trust"))
    rows = found.withColumn("_source", F.when(F.col("document_key").contains(":"), F.substring_index("document_key", ":", 1))).join(trust, "_source", "left")
    valid, kinds = F.coalesce(F.col("materiality_candidate").between(1, 5), F.lit(False)), dict(cards.dtypes)
    text = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("unit", "reported_change")]
    filled = sum((x.cast("int") for x in [*text, *[F.col(c).isNotNull() for c in ("low", "midpoint", "high")], valid]), F.lit(0))
    rank = [F.coalesce("_trust", F.lit(-(2**31))), filled, F.coalesce(F.unix_micros("extracted_at"), F.lit(-(2**63)))]
    filled_in = {f: (F.col(f), F.coalesce(F.col(f) != "", F.lit(False)) if kinds[f] == "string" else F.col(f).isNotNull()) for f in fields}
    out = survive(rows, ["record_kind", "_key"], "card_seq", rank, {"materiality_candidate": (F.col("materiality_candidate"), valid), **filled_in}, {"source": F.col("_source")})
    return out.where("copies > 1")
