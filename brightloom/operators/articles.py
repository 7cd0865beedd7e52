"""News: sources by rank, what a search found, the removal of articles that share a link or a title with one taken before them, and items checked against articles.

Defined cases: null and blank titles are no titles; null links are one link; equal order is settled by the columns given, which should be unique;
an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import urls
from brightloom.operators.groups import first_rows, top_rows

# Ranks and names of news domains, and the rank of others.
DOMAIN_SCORES = {
    "reuters.com": 100, "bloomberg.com": 98, "ft.com": 96, "wsj.com": 95, "apnews.com": 94, "cnbc.com": 92, "nikkei.com": 90, "asia.nikkei.com": 90, "federalreserve.gov": 88,
    "sec.gov": 88, "ecb.europa.eu": 88, "boj.or.jp": 88, "mof.go.jp": 88, "nvidia.com": 86, "tsmc.com": 86, "intel.com": 86,
}
DOMAIN_NAMES = {
    "reuters.com": "Reuters", "bloomberg.com": "Bloomberg", "ft.com": "Financial Times", "wsj.com": "Wall Street Journal", "apnews.com": "AP", "cnbc.com": "CNBC", "nikkei.com": "Nikkei", "asia.nikkei.com": "Nikkei Asia",
    "federalreserve.gov": "Federal Reserve", "sec.gov": "SEC", "ecb.europa.eu": "ECB", "boj.or.jp": "日本銀行", "mof.go.jp": "日本財務省", "nvidia.com": "NVIDIA", "tsmc.com": "TSMC", "intel.com": "Intel",
}
OTHER_DOMAIN_SCORE = 50
MOST_SUMMARY = 300
# end of fixed values


def bare_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def _by_domain(domain: Column, values: dict, default: Column) -> Column:
    """The value of the first listed domain that this one is, or is below."""
    d, out = bare_domain(domain), None
    for name, v in values.items():
        hit = (d == name) | d.endswith(f".{name}")
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return default if out is None else out.otherwise(default)


def domain_score(domain: Column, scores: dict[str, int] | None = None, default: int = OTHER_DOMAIN_SCORE) -> Column:
    return _by_domain(domain, DOMAIN_SCORES if scores is None else scores, F.lit(default))


def source_name(domain: Column, names: dict[str, str] | None = None) -> Column:
    return _by_domain(domain, DOMAIN_NAMES if names is None else names, domain)


def title_words(title: Column) -> Column:
    """The Latin words and numbers of a title in lower case; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def discovered(found: DataFrame, url: str, title: str, seen: str, now: Column, order: list[Column], hours: int = 24) -> DataFrame:
    """What a search found of the last hours: secure links with a title and a host, the first of each canonical link. Adds link and domain."""
    rows = found.withColumn("link", urls.article_key(F.trim(url))).withColumn("domain", bare_domain(urls.host(F.col("link"))))
    kept = F.col("link").startswith("https://") & (F.col("domain") != "") & (F.trim(F.coalesce(F.col(title), F.lit(""))) != "") & F.col(seen).between(now - F.make_interval(hours=F.lit(hours)), now)
    return first_rows(rows.where(kept), ["link"], order)


def pick(articles: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` articles of each group in order, none sharing a link or a title with one taken before it.

    This is the walk through the articles one by one, over a bounded prefix: of rows with one link, or one title, only the first `most` can matter, as
    each of those left behind was stopped by another article taken, and no more than `most` are. What is then stopped by the taken ones is at most `most` rows
    for each of their links and titles, so that of a group's rows most + 2 * most * most are walked through, whatever its size."""
    rows = articles.withColumns({"link": urls.article_key(F.col("url")), "tkey": title_words(F.col("title"))})
    cols = [c for c in rows.columns if c not in by]
    rows = first_rows(rows, [*by, "link", "tkey"], order)
    rows = top_rows(rows, [*by, "link"], order, most, "_n").drop("_n")
    rows = top_rows(rows.where("tkey <> ''"), [*by, "tkey"], order, most, "_n").drop("_n").unionByName(rows.where("tkey = ''"))
    rows = top_rows(rows, by, order, most + 2 * most * most, "_n")
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.struct(*cols).alias("row")))).alias("all"))

    def step(taken: Column, x: Column) -> Column:
        row = x["row"]
        stopped = F.exists(taken, lambda t: t["link"].eqNullSafe(row["link"]) | ((row["tkey"] != "") & (t["tkey"] == row["tkey"])))
        return F.when((F.size(taken) >= most) | stopped, taken).otherwise(F.concat(taken, F.array(row)))

    empty = F.transform(F.slice("all", 1, 0), lambda x: x["row"])
    out = groups.select(*by, F.posexplode(F.aggregate("all", empty, step)).alias("at", "row"))
    return out.select(*by, *[F.col("row")[c].alias(c) for c in cols if c != "tkey"], (F.col("at") + 1).alias("picked"))


def validated(items: DataFrame, articles: DataFrame, now: Column, order: list[Column], by: list[str], most: int, hours: int = 24) -> DataFrame:
    """Items (url, headline, fact, summary) whose link is that of an article of the last hours (link, effective_at, source_name), with nothing empty and a short summary;
    the first `most` of each group, with the article's date and source."""
    raw = items.withColumns({"link": urls.article_key(F.trim("url")), **{c: F.trim(F.coalesce(c, F.lit(""))) for c in ("headline", "fact", "summary")}})
    ok = (F.col("headline") != "") & (F.col("fact") != "") & (F.col("summary") != "") & (F.length("summary") <= MOST_SUMMARY)
    fresh = articles.where(F.col("effective_at").between(now - F.make_interval(hours=F.lit(hours)), now)).select("link", "effective_at", "source_name")
    return top_rows(raw.where(ok).join(fresh, "link"), by, order, most, "item")


def split_blocks(texts: Column, limit: int = 3900, glue: str = "\n\n") -> Column:
    """Blocks joined into messages within a limit; a block is never split."""
    from brightloom.operators.unitize import greedy_groups

    group = greedy_groups(F.transform(texts, F.length), limit, glue=len(glue))
    last = F.coalesce(F.try_element_at(group, F.lit(-1)), F.lit(0))
    tagged = F.arrays_zip(texts.alias("t"), group.alias("g"))
    numbers = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.array_join(F.transform(F.filter(tagged, lambda x: x["g"] == k), lambda x: x["t"]), glue))
