"""Checks of facts and reports. Each gives rows of (key, issue), so that checks can be united and counted.

Reports come as rows of lines (key, line_no, line) or, with the heading above each line, (key, line_no, line, section); `lines` and `assign_sections` make them.
Null texts have no lines; a report without lines has no row in a check of lines; empty tables give empty results."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import text

# Words that say that a range has one end only; what a report must not say; its headings, older headings and emoji; metrics, marks of interpretation, customer concepts; strong claims, what backs them, and words that deny them or leave them open.
LOWER_WORDS = r"\b(?:at least|more than|over|minimum)\b|至少|以上|超過"
UPPER_WORDS = r"\b(?:at most|less than|up to|maximum)\b|至多|以下|低於"
ADJUSTED_TYPES = ["adjusted_fcf", "other_adjusted", "adjusted"]
CONVERTED_UNITS = ["億美元", "兆美元", "億美金", "兆美金"]
SELF_CORRECTION = ["應為", "更正為"]
HEADINGS = ["💡 投資結論與邏輯", "📊 關鍵數據與財測", "🧭 營運動能與法說攻防", "⚠️ 風險、反證與待驗證"]
OLD_HEADINGS = ["核心投資結論", "本期變化", "本季變化", "跨段資訊整合", "關鍵論述與證據", "財測與共識", "關鍵指標", "業務部門", "因果鏈與單位經濟", "未來展望", "法說 Q&A", "反證與未知"]
HEADING_EMOJI = "[💡🔄🧩📌📢📈🏢🔗🔮🎙️⚖️⚠️📊🧭\\s]+"
METRICS = [
    "product revenue", "產品營收", "revenue", "總營收", "營收", "sales", "売上", "operating margin", "營業利益率", "營業利潤率", "営業利益率", "gross margin", "毛利率", "rpo", "backlog", "受注残", "orders", "受注",
    "eps", "fcf", "free cash flow", "capex", "設備投資", "guidance", "指引", "業績予想", "nrr", "net revenue retention",
]
READ_THROUGH = ["→", "顯示", "意味", "代表", "反映", "說明", "因此", "但", "而", "暗示", "表明", "可見", "指向", "對投資", "read-through", "意味著", "換言之", "仍不能", "尚不能"]
CUSTOMER_CONCEPTS = {
    "customer_base": ["總客戶", "total customer", "customer count", "customers total", "客戶數"],
    "large_customer": [">$1m", "$1m", "100 萬美元", "100萬美元", ">$10m", "$10m", "1,000 萬美元", "1000萬美元", "million ttm"],
    "retention": ["nrr", "net revenue retention", "淨營收留存", "retention rate"],
    "backlog": ["rpo", "remaining performance obligation", "剩餘履約義務"],
    "global_enterprise": ["global 2000", "forbes global 2000"],
    "usage": ["consumption", "usage", "使用量", "消費量"],
}
STRONG_CLAIMS = {
    "pricing_power": ["定價權", "定價能力", "pricing power", "価格決定力"],
    "bottleneck_control": ["瓶頸供應商", "瓶頸供應", "bottleneck supplier", "control point", "控制點", "支配性市占", "支配的シェア", "獨占", "独占"],
}
DIRECT_EVIDENCE = {
    "pricing_power": ["定價權", "pricing power", "価格決定力"],
    "bottleneck_control": ["bottleneck", "control point", "瓶頸", "控制點", "sole source", "single source", "exclusive", "獨占", "独占", "支配性市占", "支配的シェア"],
}
DENIAL = r"(?:不能|無法|未能|尚未)[^。；，,]{0,12}(?:判定|確認|證實)|沒有證據(?:證實|支持)|缺乏.*證據|是否(?:存在|具備|具有)|not (?:established|proven|confirmed)|cannot (?:establish|confirm)"
PENDING = r"(?:仍|尚)?(?:有待|待)驗證|(?:尚|仍)未(?:證實|確認)"
MOST_REPORT, MOST_LINES, MOST_BULLETS = 1800, {1: 7}, {0: 2, 1: 5, 3: 3}
CONSENSUS_NOTE = "外部市場共識未納入，本報告不判定 Beat/Miss。"
# end of fixed values


def issues(df: DataFrame, key: list[str], found: dict[str, Column]) -> DataFrame:
    """A row for each key and named predicate that holds."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    return df.select(*key, F.explode(named).alias("issue"))


def fact_issues(cards: DataFrame, key: str = "card_seq") -> DataFrame:
    """Ranges with one end that no word explains, midpoints off the middle by more than 0.2 percent, and adjusted metrics without a reconciliation or of a wrong type."""
    low, mid, high = F.col("low"), F.col("midpoint"), F.col("high")
    quote, kind = F.lower(F.coalesce("quote", F.lit(""))), F.coalesce("guidance_type", F.lit(""))
    half = low.isNull() != high.isNull()
    explained = ((kind == "lower_bound") & high.isNull() & quote.rlike(LOWER_WORDS)) | ((kind == "upper_bound") & low.isNull() & quote.rlike(UPPER_WORDS))
    middle = (low + high) / 2
    off = F.abs(mid - middle) > F.greatest(F.lit(1e-9), F.abs(middle) * 0.002)
    metric, of_type = F.lower(F.coalesce("metric", F.lit(""))), F.lower(F.coalesce("metric_type", F.lit("")))
    adjusted = metric.contains("adjusted")
    bare = F.coalesce(F.size("reconciliation"), F.lit(0)) <= 0
    return issues(cards, [key], {
        "incomplete_range": half & ~explained, "midpoint_not_range_average": F.coalesce(off, F.lit(False)), "adjusted_metric_taxonomy_mismatch": adjusted & ~of_type.isin(ADJUSTED_TYPES),
        "adjusted_mislabelled_standard": adjusted & (of_type == "standard_fcf"), "adjusted_metric_missing_reconciliation": (adjusted | (of_type == "adjusted_fcf")) & bare,
    })


def consensus_issues(facts: DataFrame, key: str, consensus: str) -> DataFrame:
    """Facts that hold a market consensus, for which there is no provider. consensus: an array column."""
    return issues(facts, [key], {"market_consensus_without_provider": F.size(consensus) > 0})


def report_issues(reports: DataFrame, key: str, content: str) -> DataFrame:
    """Reports that hold converted currency units, or words by which a writer corrects itself."""
    said = F.coalesce(F.col(content), F.lit(""))
    return issues(reports, [key], {"converted_currency_unit": text.contains_any(said, CONVERTED_UNITS), "self_correction": text.contains_any(said, SELF_CORRECTION)})


def unbacked_rates(claims: DataFrame, key: str, claim: str, source: str, change: str | None = None) -> DataFrame:
    """Rates in a claim that aren't in its source, a row each.

    change: a column with a number that is a rate in percent where the source holds this very number, with or without the sign."""
    backed = text.rate_tokens(F.col(source))
    if change:
        number = F.regexp_replace(F.regexp_replace(F.col(change).cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        bare = F.regexp_replace(number, "^-", "")
        held = F.regexp_like(F.coalesce(F.col(source), F.lit("")), F.concat(F.lit(r"(?<![\d.])"), F.replace(bare, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d.])")))
        backed = F.when(F.coalesce(held, F.lit(False)), F.concat(backed, F.array(F.concat(number, F.lit("%")), F.concat(bare, F.lit("%"))))).otherwise(backed)
    return claims.select(key, F.explode(F.array_except(text.rate_tokens(F.col(claim)), backed)).alias("rate"))


def lines(documents: DataFrame, key: str, content: str = "text") -> DataFrame:
    """(key, line_no, line) of the non-blank lines of texts, trimmed, line_no from 1 in the text."""
    df = documents.select(key, F.posexplode(F.split(F.coalesce(F.col(content), F.lit("")), r"\r\n|[\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]")).alias("at", "raw"))
    return df.select(key, (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line")).where("line <> ''")


def repeated_lines(line_rows: DataFrame, by: list[str], least: int = 28) -> DataFrame:
    """Lines of a document that occur twice or more but for case, blanks and bullets. Lines are counted by 128 bits of their normal form, and one text a group is carried."""
    bare = F.regexp_replace("line", r"^[•❓💬└-]+\s*", "")
    rows = line_rows.select(*by, text.squeeze_space(bare).alias("normal")).where(F.length("normal") >= least).withColumn("_h", F.unhex(F.md5("normal")))
    return rows.groupBy(*by, "_h").agg(F.first("normal").alias("normal"), F.count(F.lit(1)).alias("times")).where("times >= 2").drop("_h")


def year_labels(line_rows: DataFrame, key: str) -> DataFrame:
    """Fiscal-year labels that occur more than twice after a document's first line."""
    first = line_rows.groupBy(key).agg(F.min("line_no").alias("_first"))
    rest = line_rows.join(first, key).where("line_no > _first")
    years = rest.select(key, F.explode(F.regexp_extract_all("line", F.lit(r"(?i)\bFY\s*(?:20)?(\d{2})\b"), F.lit(1))).alias("yy"))
    return years.groupBy(key, F.concat(F.lit("20"), "yy").alias("year")).agg(F.count(F.lit(1)).alias("times")).where("times > 2")


def assign_sections(line_rows: DataFrame, key: str, heading: Column) -> DataFrame:
    """Each line with the last heading at or before it in its document; lines before any heading have none. A group is one text's lines."""
    tagged = line_rows.withColumn("_h", F.when(heading, F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("section", F.last("_h", ignorenulls=True).over(w)).where("_h IS NULL").drop("_h")


def density(line_rows: DataFrame, key: str) -> DataFrame:
    """Lines, bullets and characters of each document."""
    return line_rows.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("•") | F.col("line").startswith("- ")).alias("bullets"), F.sum(F.length("line")).alias("chars"))


def _numbers(line: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(text.number_tokens(line), lambda n: F.regexp_replace(F.lower(F.trim(n)), r"\s+", " "))))


def metric_in_sections(sectioned: DataFrame, key: str, metrics: list[str] | None = None, least: int = 3) -> DataFrame:
    """Metrics with the same first four numbers in `least` sections of a document or more."""
    rows = sectioned.select(key, F.coalesce("section", F.lit("header")).alias("section"), "line", text.squeeze_space(F.col("line")).alias("_low"))
    found = F.filter(F.array(*map(F.lit, METRICS if metrics is None else metrics)), lambda m: F.contains(F.col("_low"), m))
    numbers = F.slice(_numbers(F.col("line")), 1, 4)
    rows = rows.select(key, "section", F.try_element_at(found, F.lit(1)).alias("metric"), F.array_join(numbers, "/").alias("numbers")).where("metric IS NOT NULL AND numbers <> ''")
    return rows.groupBy(key, "metric", "numbers").agg(F.count_distinct("section").alias("sections")).where(F.col("sections") >= least)


def shared_pairs(sectioned: DataFrame, key: str, metrics: list[str] | None, a: str, b: str) -> DataFrame:
    """Pairs of a metric and a number that occur in both of two sections of a document."""
    rows = sectioned.select(key, "section", "line", text.squeeze_space(F.col("line")).alias("_low")).where(F.col("section").isin(a, b))
    found = F.slice(F.filter(F.array(*map(F.lit, METRICS if metrics is None else metrics)), lambda m: F.contains(F.col("_low"), m)), 1, 2)
    rows = rows.select(key, "section", F.explode(found).alias("metric"), _numbers(F.col("line")).alias("n")).select(key, "section", "metric", F.explode("n").alias("number"))
    return rows.where(F.col("section") == a).select(key, "metric", "number").intersect(rows.where(F.col("section") == b).select(key, "metric", "number"))


def _plain(words: str) -> str:
    """The normal form of a fixed text, as text.squeeze_space gives it, without a colon at its end."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", words).casefold()).strip().rstrip(":").rstrip()


def heading_of(line: Column, headings: list[str] | None = None) -> Column:
    """The heading that a line is, but for case, blanks, forms of characters and a colon at its end; null for other lines."""
    plain = F.rtrim(F.regexp_replace(text.squeeze_space(line), r":+$", ""))
    return F.create_map(*[F.lit(x) for h in (HEADINGS if headings is None else headings) for x in (_plain(h), h)])[plain]  # the line's form is made once


def structure_issues(line_rows: DataFrame, key: str, headings: list[str] | None = None, old: list[str] | None = None) -> DataFrame:
    """Headings that a report lacks, has in another order or twice, and older ones that it holds. Only heading lines are gathered."""
    headings, old = HEADINGS if headings is None else headings, OLD_HEADINGS if old is None else old
    bare = F.regexp_replace("line", f"^{HEADING_EMOJI}", "")
    longest = max(map(len, (*headings, *old))) + 40
    short = F.when(F.length("line") <= longest, F.col("line"))  # a heading with some emoji, blanks and a colon; longer lines are none
    rows = line_rows.select(key, "line_no", heading_of(short, headings).alias("h"), heading_of(F.when(short.isNotNull(), bare), old).alias("o"))
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("line_no", "h")))).alias("found"), F.array_sort(F.collect_set("o")).alias("old"))
    docs = docs.select(key, F.transform("found", lambda x: x["h"]).alias("found"), "old")
    all_ = F.array(*map(F.lit, headings))
    missing = F.array_except(all_, F.col("found"))
    return issues(docs, [key], {
        "missing_sections": F.size(missing) > 0, "section_order": (F.size("found") > 0) & (F.col("found") != F.filter(all_, lambda h: F.array_contains(F.col("found"), h))),
        "repeated_heading": F.size("found") != F.size(F.array_distinct("found")), "older_sections": F.size("old") > 0,
    })


def bare_lines(sectioned: DataFrame, key: str) -> DataFrame:
    """Lines below a heading that don't begin with a bullet."""
    return sectioned.where(F.col("section").isNotNull() & ~F.col("line").startswith("• ")).select(key, "line_no", F.lit("no_bullet").alias("issue"))


def uninterpreted(sectioned: DataFrame, key: str, section: str, marks: list[str] | None = None) -> DataFrame:
    """(key, line_no, issue) of a section's lines with a number and no word on what it means, and of its table rows where there are two or more (line_no null)."""
    data = sectioned.where(F.col("section") == section).select(key, "line_no", "line", text.squeeze_space(F.regexp_replace("line", r"^[•-]+\s*", "")).alias("_low")).where(F.size(text.number_tokens(F.col("line"))) > 0)
    row = F.col("line").contains("|")
    tables = data.where(row).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(key, F.lit(None).cast("long").alias("line_no"), F.lit("raw_table").alias("issue"))
    said = text.contains_any(F.col("_low"), [m.casefold() for m in (READ_THROUGH if marks is None else marks)]) | (F.col("_low") == _plain(CONSENSUS_NOTE))
    return data.where(~row & ~said).select(key, F.col("line_no").cast("long").alias("line_no"), F.lit("number_without_meaning").alias("issue")).unionByName(tables)


def concepts_in(low: Column, concepts: dict[str, list[str]]) -> Column:
    """The concepts that a text in its normal form names, in their order."""
    return F.array_compact(F.array(*[F.when(text.contains_any(low, [w.casefold() for w in words]), F.lit(c)) for c, words in concepts.items()]))


def untriangulated(sectioned: DataFrame, facts: DataFrame, key: str, fact: str, sections: list[str], concepts: dict[str, list[str]] | None = None, marks: list[str] | None = None, least: int = 3) -> DataFrame:
    """Reports whose facts name `least` customer concepts or more, but that hold no line which names two of them and says what they mean.

    facts: (key, fact), a row each. Concepts are sets of a few values, so groups carry bits and not texts."""
    concepts = CUSTOMER_CONCEPTS if concepts is None else concepts
    named = facts.select(key, text.squeeze_space(F.col(fact)).alias("_low")).select(key, F.explode(concepts_in(F.col("_low"), concepts)).alias("c"))
    known = named.groupBy(key).agg(F.array_sort(F.collect_set("c")).alias("concepts")).where(F.size("concepts") >= least)
    rows = sectioned.where(F.col("section").isin(sections)).select(key, text.squeeze_space(F.col("line")).alias("_low"))
    good = (F.size(concepts_in(F.col("_low"), concepts)) >= 2) & text.contains_any(F.col("_low"), [m.casefold() for m in (READ_THROUGH if marks is None else marks)])
    return known.join(rows.where(good).select(key).distinct(), key, "left_anti")


def dense(sectioned: DataFrame, key: str, headings: list[str] | None = None) -> DataFrame:
    """(key, issue, n) of reports that are too long or whose sections hold too many lines or bullets."""
    headings = HEADINGS if headings is None else headings
    at = {h: i for i, h in enumerate(headings)}
    bullet = F.col("line").startswith("•")
    per = sectioned.where(F.col("section").isin(headings)).groupBy(key, "section").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bullet).alias("bullets"))
    limit = lambda limits: F.create_map(*[F.lit(x) for h, i in at.items() for x in (h, limits.get(i, 2**31 - 1))])[F.col("section")]
    found = F.array_compact(F.array(F.when(F.col("lines") > limit(MOST_LINES), F.struct(F.lit("too_many_lines").alias("issue"), F.col("lines").alias("n"))), F.when(F.col("bullets") > limit(MOST_BULLETS), F.struct(F.lit("too_many_bullets").alias("issue"), F.col("bullets").alias("n")))))
    long_ = sectioned.groupBy(key).agg(F.sum(F.length("line") + 1).alias("n")).where(F.col("n") - 1 > MOST_REPORT)
    return per.select(key, "section", F.explode(found).alias("x")).select(key, "section", "x.*").unionByName(long_.select(key, F.lit(None).cast("string").alias("section"), F.lit("too_long").alias("issue"), (F.col("n") - 1).alias("n")))


def language_issues(documents: DataFrame, key: str, content: str = "text", least: int = 240, most_cjk: int = 120, share: float = 0.22) -> DataFrame:
    """Texts of some length with few CJK letters, or a small share of them."""
    cjk, latin = text.latin_share(F.col(content))
    few = (cjk < most_cjk) | ((latin > 0) & (cjk / (cjk + latin) < share))
    return documents.where(F.length(content) >= least).select(key, cjk.alias("cjk"), latin.alias("latin"), few.alias("predominantly_latin"))


def strong_claims(line_rows: DataFrame, key: str, claims: dict[str, list[str]] | None = None, denial: str = DENIAL, pending: str = PENDING) -> DataFrame:
    """(key, category) of claims asserted in a clause: not within 32 characters after a denial, nor right before words that leave it open."""
    clauses = line_rows.select(key, text.squeeze_space(F.col("line")).alias("_low")).select(key, F.explode(F.split("_low", r"[。；;，,]")).alias("clause"))
    out = None
    for category, words in (STRONG_CLAIMS if claims is None else claims).items():
        term = "|".join(w.casefold() for w in words)
        bare = F.regexp_replace("clause", rf"(?:{denial}).{{0,32}}?(?:{term})|(?:{term})(?:{pending})", "")
        rows = clauses.where(bare.rlike(f"(?:{term})")).select(key, F.lit(category).alias("category"))
        out = rows if out is None else out.unionAll(rows)
    return out.distinct()


def unbacked_claims(line_rows: DataFrame, facts: DataFrame, key: str, fact: str, claims: dict[str, list[str]] | None = None, evidence: dict[str, list[str]] | None = None, denial: str = DENIAL, pending: str = PENDING) -> DataFrame:
    """Strong claims of a report that has facts, none of which holds direct evidence of the category."""
    backed = facts.select(key, text.squeeze_space(F.col(fact)).alias("_low")).select(key, F.explode(concepts_in(F.col("_low"), DIRECT_EVIDENCE if evidence is None else evidence)).alias("category")).distinct()
    said = strong_claims(line_rows, key, claims, denial, pending).join(facts.select(key).distinct(), key, "left_semi")
    return said.join(backed, [key, "category"], "left_anti")
