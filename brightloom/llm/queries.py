"""Queries of the operators for language-model training data, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import chunks, duplicates, offence, packing, survivors, tokens, turns
from brightloom.session import table


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, turns.Roster]:
    return turns.with_company(table(spark, sf_dir, "evidence"), table(spark, sf_dir, "disclosures")), turns.roster_of(table(spark, sf_dir, "participants"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every transcript with its speaker and clean words."""
    scripts, roster = _transcripts(spark, sf_dir)
    return turns.speaker_turns(scripts, roster, turns.cleaner_of(table(spark, sf_dir, "filler_terms")), turns.trained(scripts, roster))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of transcripts, and the speakers that cards' labels name."""
    scripts, roster = _transcripts(spark, sf_dir)
    spoken = turns.speaker_turns(scripts, roster, turns.cleaner_of(table(spark, sf_dir, "filler_terms")), turns.trained(scripts, roster))
    said = spoken.select(F.lit("turn").alias("record_kind"), F.col("evidence_id").alias("record_id"), "turn_no", "speaker_id", "n_words")
    labels = turns.card_speakers(table(spark, sf_dir, "cards"), roster)
    return said.unionByName(labels.select("record_kind", "record_id", F.lit(0).alias("turn_no"), "speaker_id", F.lit(0).alias("n_words")))


def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement, metric and period of cards and of feed payloads."""
    cards = table(spark, sf_dir, "cards").select(F.lit("card").alias("record_kind"), F.col("card_seq").alias("record_id"), "statement", "metric", "period")
    feed = duplicates.feed_fields(table(spark, sf_dir, "card_feed")).select(F.lit("feed"), "feed_id", "statement", "metric", "period")
    return cards.unionAll(feed)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more records that differ only in how they are written."""
    return duplicates.groups(written_records(spark, sf_dir), "record_kind", "record_id", ["statement", "metric", "period"])


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, with its number of copies."""
    return duplicates.collapse(written_records(spark, sf_dir), "record_kind", "record_id", ["statement", "metric", "period"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized evidence texts, and whether they hold a run without a natural boundary."""
    return chunks.oversized(table(spark, sf_dir, "evidence"), "evidence_id").select("evidence_id", "hard_cut")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized evidence text."""
    return chunks.pieces(table(spark, sf_dir, "evidence"), "evidence_id")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every oversized text put together from its pieces, and whether the pieces keep their size, overlap and boundaries."""
    return chunks.rebuilt(p5_pieces(spark, sf_dir), "evidence_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group of copied cards."""
    best = survivors.best_cards(table(spark, sf_dir, "cards"), table(spark, sf_dir, "source_profile"))
    return best.select("first_id", "survivor_id", "source", "materiality_candidate")


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group of copied cards, with every attribute built field by field."""
    return survivors.best_cards(table(spark, sf_dir, "cards"), table(spark, sf_dir, "source_profile"), survivors.FIELDS)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the containers of every spec."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of every spec are."""
    return packing.fill(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def scored_documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    machine = offence.train_on(offence.hashed(offence.labelled(documents, table(spark, sf_dir, "content_labels"))))
    return offence.score(documents, machine, list(keep))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold abusive, hateful or sexual language."""
    return offence.cases(scored_documents(spark, sf_dir, "doc_id")).select("doc_id", "category")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score in each category."""
    return scored_documents(spark, sf_dir, "doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's documents, cases and share of each category."""
    return offence.rates(scored_documents(spark, sf_dir, "source"))


QUERIES = {
    "p2_found": p2_found, "p2_turns": p2_turns,
    "p3_found": p3_found, "p3_collapsed": p3_collapsed, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_ids": p7_ids,
    "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}


def _canonical(c: str) -> str:
    """Canonical form in SQL without lookaround: U+0001 for a minus, U+0002 for a decimal point."""
    s = f"lower(upper(coalesce({c}, '')))"
    minus = r"'(^|[^\p{L}\p{N}])[-−‐‑‒–﹣－](\p{Sc}?\.?\d)'"
    s = rf"regexp_replace({s}, {minus}, '\1' || chr(1) || '\2', 'g')"
    point = r"'(^|[^\p{L}.])\.(\d)'"
    for _ in range(2):  # neighbouring matches share a character
        s = rf"regexp_replace({s}, {point}, '\1' || chr(2) || '\2', 'g')"
    kept = rf"replace(replace(replace({s}, '%', chr(4)), '‰', chr(5)), '‱', chr(6))"
    return rf"regexp_replace({kept}, '[\p{{P}}\p{{Z}}\p{{Cf}}\s|`^~´¨]+', '', 'g')"


def _feed_field(name: str) -> str:
    json = f"(SELECT max(m.value) FROM (SELECT unnest(map_entries(from_json(CASE WHEN starts_with(trim(payload), '{{') THEN payload ELSE '{{}}' END, '\"MAP(VARCHAR, VARCHAR)\"'))) AS m) WHERE lower(m.key) = '{name}')"
    any_ = "(?:statement|metric|period)"
    pairs = rf"regexp_extract(payload, '(?is)(?:^|\|)\s*{name}\s*=(.*?)(?:\|\s*{any_}\s*=|$)', 1)"
    lines = rf"regexp_extract(payload, '(?is)(?:^|\n)[ \t]*{name}[ \t]*:(.*?)(?:\n[ \t]*{any_}[ \t]*:|$)', 1)"
    return f"CASE WHEN starts_with(trim(payload), '{{') THEN {json} WHEN regexp_matches(payload, '(?i)^\\s*{any_}\\s*=') THEN {pairs} ELSE {lines} END AS {name}"


_WRITTEN = f"""
WITH written AS (
  SELECT 'card' AS record_kind, card_seq AS record_id, statement, metric, period FROM cards
  UNION ALL SELECT 'feed', feed_id, {_feed_field("statement")}, {_feed_field("metric")}, {_feed_field("period")} FROM card_feed
), keyed AS (
  SELECT record_kind, record_id, {_canonical("statement")} AS s, {_canonical("metric")} AS m, {_canonical("period")} AS p FROM written
)"""

_VALID = "materiality_candidate BETWEEN 1 AND 5"
_FILLED = " + ".join(
    [f"(coalesce({c}, '') <> '')::INT" for c in ("unit", "reported_change")] + [f"({c} IS NOT NULL)::INT" for c in ("low", "midpoint", "high")] + [f"coalesce({_VALID}, false)::INT"]
)
_RANKED = f"""
WITH keyed AS (
  SELECT c.*, {_canonical("statement")} AS s, {_canonical("metric")} AS m, {_canonical("c.period")} AS p, split_part(c.document_key, ':', 1) AS true_source
  FROM cards c
), ranked AS (
  SELECT k.*, row_number() OVER w AS place, count(*) OVER (PARTITION BY s, m, p) AS n, min(card_seq) OVER (PARTITION BY s, m, p) AS first_id
  FROM keyed k LEFT JOIN source_profile f ON f.source = k.true_source
  WINDOW w AS (PARTITION BY s, m, p ORDER BY f.trust_score DESC NULLS LAST, {_FILLED} DESC, extracted_at DESC NULLS LAST, card_seq)
)"""
SQL = {
    "p3_found": f"{_WRITTEN} SELECT record_kind, min(record_id) AS first_id, count(*)::INT AS copies FROM keyed GROUP BY record_kind, s, m, p HAVING count(*) > 1",
    "p3_collapsed": f"{_WRITTEN} SELECT record_kind, min(record_id) AS first_id, count(*)::INT AS copies FROM keyed GROUP BY record_kind, s, m, p",
    "p5_found": r"""
SELECT evidence_id, (list_max(list_transform(string_split_regex(text, '[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？]'), lambda x: length(x))) > 4000)::INT AS hard_cut
FROM evidence WHERE length(text) > 4000""",
    "p5_rebuilt": "SELECT evidence_id, sha256(text) AS digest, length(text)::INT AS chars, true AS within, true AS shared, true AS \"natural\" FROM evidence WHERE length(text) > 4000",
    "p6_found": f"""{_RANKED}
SELECT first_id, max(card_seq) FILTER (WHERE place = 1) AS survivor_id, max(true_source) FILTER (WHERE place = 1) AS source,
  arg_min(materiality_candidate, place) FILTER (WHERE {_VALID}) AS materiality_candidate
FROM ranked WHERE n > 1 GROUP BY s, m, p, first_id""",
    "p6_survivors": f"""{_RANKED}
SELECT first_id, any_value(n)::INT AS copies, max(card_seq) FILTER (WHERE place = 1) AS survivor_id, max(true_source) FILTER (WHERE place = 1) AS source,
  arg_min(materiality_candidate, place) FILTER (WHERE {_VALID}) AS materiality_candidate,
  {", ".join(f"arg_min({c}, place) FILTER (WHERE {c} <> '') AS {c}" for c in ("card_type", "topic", "fact_class", "value_text", "unit", "reported_change", "speaker", "analyst", "management_speaker", "question_summary", "answer_summary", "metric_type", "guidance_type"))},
  {", ".join(f"arg_min({c}, place) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("value_num", "low", "midpoint", "high"))}
FROM ranked WHERE n > 1 GROUP BY s, m, p, first_id""",
}
