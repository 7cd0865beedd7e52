"""Evidence cards: deduplication with the strongest survivor, selection under quotas, inventories, joins with units and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import text
from brightloom.operators.groups import top_rows

MOST_CARDS = 90

# Topics of which four cards are kept before others are filled up; of the rest, two. What is kept of a card in short, and how much of its texts. How many of each category a view shows.
BROAD_TOPICS = ["demand_revenue", "guidance", "margin_unit_economics", "qa_management", "risk"]
COMPACT_FIELDS = [
    "card_id", "card_type", "topic", "statement", "metric", "value_num", "value_text", "unit", "period", "comparison_value", "comparison_period", "reported_change", "low", "midpoint", "high",
    "previous_low", "previous_midpoint", "previous_high", "materiality_candidate", "fact_class", "speaker", "analyst", "management_speaker", "question_summary", "answer_summary", "answer_quality",
    "customer", "product", "use_case", "outcome", "quantified_result", "source", "provenance", "unit_id", "document_key", "quote", "guidance_type", "metric_type", "reconciliation",
]
COMPACT_LENGTHS = {"statement": 360, "question_summary": 280, "answer_summary": 420, "quote": 240}
VIEW_LIMITS = {"facts": 120, "guidance": 30, "cash_flow_and_capex": 30, "qa": 40}
LIST_LIMITS = {
    "facts": 80, "guidance": 24, "segments": 48, "cash_flow_and_capex": 30, "quantitative_evidence": 72, "change_signals": 40, "customer_cases": 24, "industry_signals": 36,
    "management_claims": 40, "management_comments": 40, "qa": 36, "market_consensus": 12, "unknowns": 24,
}
# end of fixed values


def ranked(cards: DataFrame) -> DataFrame:
    """Adds fp (fingerprint), rank (of the source), mat (materiality from 1 to 5) and topic_key."""
    value = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    named = {n: F.col(n) for n in ("card_type", "topic", "metric", "unit", "period", "reported_change", "statement", "question_summary", "answer_summary")} | {"value": value}
    return cards.select(
        "*", text.card_fingerprint(named).alias("fp"), text.source_rank(F.col("source"), F.col("provenance")).alias("rank"), text.clamp_materiality(F.col("materiality_candidate")).alias("mat"),
        F.coalesce(F.nullif("topic", F.lit("")), F.lit("other")).alias("topic_key"),
    )


def dedupe(cards: DataFrame, by: list[str], seq: str = "card_seq", keep: list[str] | None = None) -> DataFrame:
    """One card for each fingerprint within `by`: the highest rank, then materiality, then the first; first_seq is the place of the first of them.

    One aggregation by 128 bits of the fingerprint, pre-aggregated on the map side, that carries only the columns in keep (all where it is None).
    A card with an empty fingerprint is equal to no other."""
    keys = [*by, "_f"]
    cols = [c for c in cards.columns if c not in by] if keep is None else [seq, *[c for c in keep if c not in by and c != seq]]
    alone = F.concat(F.lit("\u0000"), F.col(seq).cast("string"))
    df = cards.select("*", F.unhex(F.md5(F.when(F.col("fp") == "", alone).otherwise(F.col("fp")))).alias("_f"))
    best = F.max_by(F.struct(*cols), F.struct("rank", "mat", -F.col(seq))).alias("_b")
    out = df.groupBy(*keys).agg(best, F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("copies"))
    return out.select(*by, *[F.col("_b")[c].alias(c) for c in cols], "first_seq", "copies")


def mandatory() -> Column:
    kind = F.coalesce("card_type", F.lit(""))
    return (F.col("mat") >= 4) | (kind == "guidance") | ((kind == "qa") & (F.col("mat") >= 3))


def select(deduped: DataFrame, by: str, seq: str = "card_seq", most: int = MOST_CARDS) -> DataFrame:
    """The selected cards of each group: all mandatory ones; then in the order of topics the best until a topic has four or two; then the best until `most`.

    Mandatory cards need no order and are only counted. Of the optional, a group's candidates are at most its quotas'
    first few and its `most` best, so that the running counts are over a bounded number of rows, whatever the group is."""
    df = deduped.withColumn("_m", mandatory())
    must = df.where("_m")
    target = F.when(F.col("topic_key").isin(BROAD_TOPICS), 4).otherwise(2)
    order = [F.desc("mat"), F.desc("rank"), F.asc(F.coalesce("position", F.lit(0))), F.asc("first_seq")]
    per_topic = must.groupBy(by, "topic_key").agg(F.count(F.lit(1)).alias("_have"))
    total = must.groupBy(by).agg(F.count(F.lit(1)).alias("_musts"))
    optional = df.where("NOT _m")
    known = F.col("topic_key").isin(text.TOPICS)
    quota = top_rows(optional.where(known).withColumn("_target", target), [by, "topic_key"], order, 4, "_in_topic")
    quota = quota.join(per_topic, [by, "topic_key"], "left").where(F.col("_in_topic") <= F.col("_target") - F.coalesce("_have", F.lit(0))).join(total, by, "left")
    by_topic = Window.partitionBy(by).orderBy(text.topic_rank(F.col("topic_key")), "_in_topic")  # at most four a topic
    quota = quota.withColumn("_n", F.row_number().over(by_topic)).where(F.col("_n") + F.coalesce("_musts", F.lit(0)) <= most)
    taken = quota.groupBy(by).agg(F.count(F.lit(1)).alias("_taken"))
    best = top_rows(optional, [by], order, most + 4 * len(text.TOPICS), "_overall").join(quota.select(by, seq), [by, seq], "left_anti")
    fill = best.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("_overall"))).join(total, by, "left").join(taken, by, "left")
    fill = fill.where(F.col("_n") + F.coalesce("_musts", F.lit(0)) + F.coalesce("_taken", F.lit(0)) <= most)
    tag = lambda d, how: d.select(by, seq, "topic_key", "mat", "unit_id", F.lit(how).alias("why"))
    return tag(must, "mandatory").unionAll(tag(quota, "quota")).unionAll(tag(fill, "fill"))


def report_order() -> list[Column]:
    """The ascending keys of the order of selected cards in a report: the topic, the most material first, the unit."""
    return [text.topic_rank(F.col("topic_key")), -F.col("mat"), F.coalesce("unit_id", F.lit(""))]


def diagnostics(raw: DataFrame, deduped: DataFrame, selected: DataFrame, by: str) -> DataFrame:
    n = F.count(F.lit(1))
    a = raw.groupBy(by).agg(n.alias("raw_cards"))
    b = deduped.groupBy(by).agg(n.alias("deduped_cards"))
    c = selected.groupBy(by).agg(n.alias("selected_cards"))
    out = a.join(b, by, "left").join(c, by, "left").na.fill(0)
    return out.withColumn("omitted_cards", F.greatest(F.lit(0), F.col("deduped_cards") - F.col("selected_cards")))


def inventory(cards: DataFrame, by: list[str]) -> DataFrame:
    """Cards of each topic; null and empty topics count as other."""
    return cards.groupBy(*by, F.coalesce(F.nullif("topic", F.lit("")), F.lit("other")).alias("topic")).agg(F.count(F.lit(1)).alias("cards"))


#: what selection needs of a card.
SELECTION = ["rank", "mat", "topic_key", "card_type", "position", "unit_id"]


def compact(cards: DataFrame, key: str = "card_seq") -> DataFrame:
    """Cards as sparse JSON, without nulls, empty texts and empty arrays, and with long texts shortened. Fields that the table hasn't are left out."""
    kinds = dict(cards.dtypes)

    def short(c: str) -> Column:
        if kinds[c] == "string":
            return F.nullif(F.substring(c, 1, COMPACT_LENGTHS.get(c, 2**30)), F.lit("")).alias(c)
        return F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith("array") else F.col(c)

    return cards.select(key, F.to_json(F.struct(*[short(c) for c in COMPACT_FIELDS if c in kinds]), {"ignoreNullFields": "true"}).alias("card"))


def quotes_missing(cards: DataFrame, evidence: DataFrame, least: int = 16, key: str = "card_seq", most: int = 1000) -> DataFrame:
    """Cards whose quote isn't in the text of the document that they name, both without white space and case.

    Only cards of documents that are there are checked. A document's distinct quotes are gathered in arrays of some `most`, so that each text is gone through once for
    an array and doesn't travel with every quote, and no document's quotes are one row."""
    quotes = cards.where(F.col("quote").isNotNull() & F.col("document_key").isNotNull()).select(key, "document_key", text.strip_space(F.trim("quote")).alias("_q")).where(F.length("_q") >= least)
    quotes = quotes.withColumn("_h", F.unhex(F.md5("_q")))
    texts = evidence.where("document_key IS NOT NULL").select("document_key", text.strip_space(F.col("text")).alias("_t"))
    asked = quotes.join(texts.select("document_key").distinct(), "document_key", "left_semi")
    distinct = asked.groupBy("document_key", "_h").agg(F.first("_q").alias("_q"))
    sizes = distinct.groupBy("document_key").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    arrays = distinct.join(sizes, "document_key").groupBy("document_key", F.pmod(F.xxhash64("_h"), F.col("_parts")).alias("_part")).agg(F.collect_list(F.struct("_h", "_q")).alias("_all"))
    found = arrays.join(texts, "document_key").select("document_key", F.explode(F.filter("_all", lambda x: F.contains(F.col("_t"), x["_q"]))).alias("x")).select("document_key", "x._h").distinct()
    return asked.join(found, ["document_key", "_h"], "left_anti").select(key, "document_key")


def first_issues(issues: DataFrame, by: list[str], order: list[Column], most: int = 30) -> DataFrame:
    """The first `most` issues of each group, as reports show them."""
    return top_rows(issues, by, order, most, "place")


def decorated(cards: DataFrame, unit_rows: DataFrame, index: Column) -> DataFrame:
    """Cards of known units with what the unit tells of them: their id by index and unit, document, source, provenance and position; quotes are trimmed.

    unit_rows: unit_id, document_key, source, position. Cards of unknown units are dropped."""
    own = [c for c in cards.columns if c not in ("card_id", "document_key", "source", "provenance", "position", "quote")]
    units = unit_rows.select("unit_id", F.col("document_key").alias("_key"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("position", F.lit(0)).alias("_at"))
    provenance = F.when(F.lower("_source").contains("third_party"), "third_party_transcript").otherwise("primary_or_official")
    return cards.withColumn("_i", index).join(units, "unit_id").select(
        *own, F.concat(F.lit("c"), F.col("_i"), F.lit(":"), F.col("unit_id")).alias("card_id"), F.col("_key").alias("document_key"), F.col("_source").alias("source"),
        provenance.alias("provenance"), F.col("_at").alias("position"), F.trim(F.coalesce("quote", F.lit(""))).alias("quote"),
    )


def categories(cards: DataFrame) -> DataFrame:
    """Cards with the categories that views show them in: guidance, qa, facts (with a metric, but guidance) and cash_flow_and_capex (facts of that topic). A card may be in several."""
    kind, metric = F.coalesce("card_type", F.lit("")), F.coalesce(F.col("metric") != "", F.lit(False))
    fact = metric & (kind != "guidance")
    named = {"guidance": kind == "guidance", "qa": kind == "qa", "facts": fact, "cash_flow_and_capex": fact & (F.coalesce("topic", F.lit("")) == "cash_capex")}
    return cards.withColumn("category", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))))


def bounded(rows: DataFrame, by: list[str], category: str, order: list[Column], limits: dict[str, int] | None = None) -> DataFrame:
    """The first rows of each category of a group, as many as its limit; categories without a limit are whole."""
    limits = LIST_LIMITS if limits is None else limits
    limited = rows.where(F.col(category).isin(list(limits)))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(category)]
    top = top_rows(limited, [*by, category], order, max(limits.values()), "place").where(F.col("place") <= most)
    return top.unionByName(rows.where(~F.coalesce(F.col(category).isin(list(limits)), F.lit(False))).withColumn("place", F.lit(None).cast("int")))
