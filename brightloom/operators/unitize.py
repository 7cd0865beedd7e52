"""Texts into bounded units, batches and groups by greedy folds, and the proof that all of a text is covered.

Folds run inside the JVM as aggregate() over a document's own array, so that documents are independent of one another
and of partitions. Each fold carries only sizes; texts are joined once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import text

UNIT_CHARS, BATCH_CHARS, BATCH_UNITS = 4000, 8000, 2
SECTION_CHARS, GROUP_CHARS, MOST_GROUPS = 7500, 22_000, 6
# Words of a kind or title that tell a call.
CALL_HINTS = ["transcript", "earnings call", "conference call", "prepared remarks", "q&a"]
# end of fixed values


def hard_split(parts: Column, most: int) -> Column:
    """Array of texts with those over the limit cut at it."""
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) > 0), cut))


def greedy_spans(sizes: Column, most: int, glue: int = 0, most_items: int | None = None) -> Column:
    """The groups of an array of sizes as (a, n), the place of their first item from 1 and their number of items: a new one begins where the next item would not fit.

    glue: what is added between two items of a group. The fold appends once a group and not once an item."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("items"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        grown = acc["size"] + x + glue
        full = (acc["items"] > 0) & ((grown > most) | (F.lit(most_items is not None) & (acc["items"] >= (most_items or 0))))
        opens = full | (acc["items"] == 0)
        at = acc["i"] + 1
        return F.struct(at.alias("i"), F.when(opens, x.cast("long")).otherwise(grown).alias("size"), F.when(opens, 1).otherwise(acc["items"] + 1).alias("items"), F.when(opens, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"]).alias("starts"))

    def ended(acc: Column) -> Column:
        ends = F.concat(F.slice(acc["starts"], F.lit(2), F.greatest(F.size(acc["starts"]), F.lit(1))), F.array(acc["i"] + 1))
        return F.transform(acc["starts"], lambda a, k: F.struct(a.alias("a"), (F.get(ends, k) - a).alias("n")))

    return F.aggregate(sizes, zero, step, ended)


def greedy_groups(sizes: Column, most: int, glue: int = 0, most_items: int | None = None) -> Column:
    """For each item of an array of sizes, the number of its group from 1."""
    return F.flatten(F.transform(greedy_spans(sizes, most, glue, most_items), lambda s, k: F.array_repeat(k + 1, s["n"])))


def blocks(parts: Column, most: int) -> Column:
    """Paragraphs joined by blank lines into blocks within the limit, longer ones cut."""
    joined = lambda pieces: F.transform(greedy_spans(F.transform(pieces, F.length), most, glue=2), lambda s: F.array_join(F.slice(pieces, s["a"], s["n"]), "\n\n"))
    return F.get(F.transform(F.array(hard_split(parts, most)), joined), F.lit(0))  # the pieces are made once


def kind_of(kind: Column, title: Column) -> Column:
    """A document's kind by its metadata, else by its title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    by_title = (
        F.when(text.contains_any(low, text.TRANSCRIPT_MARKERS), "transcript").when(low.contains("presentation") | low.contains("slides"), "presentation")
        .when(text.contains_any(low, ["10-q", "10-k", "20-f", "40-f"]), "filing").when(text.contains_any(low, ["earnings release", "financial results", "press release"]), "financial_results").otherwise("document")
    )
    return F.when(F.coalesce(kind, F.lit("")) != "", F.lower(kind)).otherwise(by_title)


def with_paragraphs(evidence: DataFrame) -> DataFrame:
    """Adds kind, transcript, the paragraphs that count, and from which of them on a call is in its questions."""
    df = evidence.withColumn("kind", kind_of(F.col("metadata.document_kind"), F.col("title")))
    call = F.col("kind").isin("transcript", "qa", "prepared_remarks") | F.coalesce(text.contains_any(F.lower("title"), text.TRANSCRIPT_MARKERS), F.lit(False))
    df = df.withColumn("transcript", call).withColumn("all_parts", text.paragraphs(F.col("text")))
    kept = F.filter("all_parts", text.filing_paragraph_kept)
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice("all_parts", 1, 1))
    filing = (F.col("kind") == "filing") & ~F.col("transcript")
    df = df.withColumn("parts", F.when(filing, chosen).otherwise(F.col("all_parts")))
    marks = F.transform("parts", lambda p: text.contains_any(F.lower(p), text.QA_MARKERS))
    return df.withColumn("marks", F.when(F.col("transcript"), marks))


def units(evidence: DataFrame, most: int = UNIT_CHARS, key: str = "evidence_id") -> DataFrame:
    """Every unit of every document: (key, unit_id, position, phase, n_chars, unit). Each paragraph that opens questions also opens a block.

    Structured facts are a unit of their own at position 0."""
    df = with_paragraphs(evidence)
    # spans of paragraphs that begin at each marker; what is before the first marker is the first span
    n = F.size("parts")
    opens = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | F.coalesce(F.try_element_at(F.col("marks"), i), F.lit(False)))
    ends = F.concat(F.slice(opens, 2, F.size(opens)), F.array(n + 1))
    spans = F.transform(F.arrays_zip(opens.alias("a"), ends.alias("b")), lambda s: F.struct(s["a"].alias("a"), (s["b"] - s["a"]).alias("n")))
    df = df.withColumn("spans", F.when(n > 0, spans))

    def of_span(s: Column, nth: Column) -> Column:
        asked = F.col("transcript") & F.coalesce(F.try_element_at(F.col("marks"), s["a"]) | (nth > 0), F.lit(False))
        phase = F.when(asked, "qa").when(F.col("transcript"), "prepared_remarks").otherwise(F.col("kind"))
        return F.transform(blocks(F.slice("parts", s["a"], s["n"]), most), lambda b: F.struct(phase.alias("phase"), b.alias("unit")))

    # units are numbered within their document's array, so that no text is shuffled or joined for its position
    made = df.select(key, "document_key", F.posexplode(F.flatten(F.transform("spans", of_span))).alias("at", "u"))
    position = F.col("at") + 1
    text_units = made.select(key, F.concat(F.col("document_key"), F.lit("#u"), position).alias("unit_id"), position.alias("position"), F.col("u.phase").alias("phase"), F.length("u.unit").alias("n_chars"), F.col("u.unit").alias("unit"))
    facts = F.to_json("structured_facts")
    fact_units = evidence.where(F.size("structured_facts") > 0).select(key, F.concat(F.col("document_key"), F.lit("#structured")), F.lit(0), F.lit("structured_facts"), F.length(facts), facts)
    return text_units.unionAll(fact_units)


def batches(unit_rows: DataFrame, key: str = "evidence_id", most: int = BATCH_CHARS, most_units: int = BATCH_UNITS) -> DataFrame:
    """Each unit's batch within its document, in order of position: every unit is in one batch."""
    docs = unit_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "unit_id", "n_chars"))).alias("u"))  # ids and sizes of one document
    numbers = greedy_groups(F.transform("u", lambda x: x["n_chars"]), most, most_items=most_units)
    return docs.select(key, F.explode(F.arrays_zip(F.col("u").alias("u"), numbers.alias("b"))).alias("x")).select(key, F.col("x.u.unit_id").alias("unit_id"), F.col("x.u.position").alias("position"), F.col("x.b").alias("batch"))


def unit_manifest(evidence: DataFrame, unit_rows: DataFrame, key: str = "evidence_id") -> DataFrame:
    """A row a document: characters, paragraphs and units of each phase."""
    docs = with_paragraphs(evidence).select(
        key, F.coalesce(F.nullif(F.col("metadata.raw_chars"), F.lit(0)), F.length("text"), F.lit(0)).alias("raw_chars"), F.coalesce(F.length("text"), F.lit(0)).alias("extracted_chars"),
        F.coalesce(F.col("metadata.truncated"), F.lit(False)).alias("truncated"), F.size("all_parts").alias("raw_paragraphs"), F.size("parts").alias("kept_paragraphs"), "transcript",
    )
    counts = unit_rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("phase").isin("prepared_remarks", "qa")).alias("call_units"), F.count_if(F.col("phase") == "qa").alias("qa_units"),
    )
    return docs.join(counts, key, "left").na.fill(0, ["units", "call_units", "qa_units"])


def coverage(expected: DataFrame, processed: DataFrame, by: list[str], truncated: DataFrame | None = None) -> DataFrame:
    """Of each group: expected, processed, missing and unexpected units, the covered share, and whether it is complete."""
    e = expected.select(*by, "unit_id").distinct().withColumn("_e", F.lit(1))
    p = processed.select(*by, "unit_id").distinct().withColumn("_p", F.lit(1))
    both = e.join(p, [*by, "unit_id"], "full")
    counts = both.groupBy(*by).agg(F.count("_e").alias("expected"), F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("processed"), F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"))
    cut = counts.join(truncated.select(*by).distinct().withColumn("_cut", F.lit(True)), by, "left") if truncated is not None else counts.withColumn("_cut", F.lit(None).cast("boolean"))
    ratio = F.when(F.col("expected") == 0, 1.0).otherwise(F.bround(F.col("processed") / F.col("expected"), 6))
    return cut.select(*counts.columns, ratio.alias("ratio"), ((F.col("missing") == 0) & (F.col("unexpected") == 0) & F.col("_cut").isNull()).alias("complete"))


def sections(evidence: DataFrame, most: int = SECTION_CHARS, key: str = "evidence_id") -> DataFrame:
    """The sections of texts: whole paragraphs within the limit; after a marker, or by the title, a call's are questions."""
    title = F.lower(F.coalesce("title", F.lit("")))
    call = text.contains_any(F.concat(title, F.lit("\n"), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 4000))), [*text.TRANSCRIPT_MARKERS, "question and answer"])
    by_title = text.contains_any(title, ["q&a", "question-and-answer", "questions and answers"])
    df = evidence.withColumn("_call", call).withColumn("_parts", blocks(text.paragraphs(F.col("text")), most))
    first = F.array_position(F.transform("_parts", lambda p: text.contains_any(F.lower(p), text.QA_MARKERS)), True)
    df = df.withColumn("_from", F.when(by_title, 1).when(first > 0, first).otherwise(2**30))
    out = df.select(key, "document_key", "_call", "_from", F.posexplode("_parts").alias("at", "section"))
    kind = F.when(F.col("_call") & (F.col("at") + 1 >= F.col("_from")), "qa").when(F.col("_call"), "transcript").otherwise("document")
    return out.select(key, F.concat(F.col("document_key"), F.lit("#s"), F.col("at") + 1).alias("section_id"), (F.col("at") + 1).alias("position"), kind.alias("kind"), F.length("section").alias("n_chars"), "section")


def even_sample(n: Column, slots: int) -> Column:
    """Indices from 0 of `slots` groups spread evenly over n: all if there are no more, the last if there is one slot."""
    if slots <= 0:
        return F.array().cast("array<int>")
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if slots == 1:
        return F.when(n <= 1, all_).otherwise(F.array(n - 1))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.bround(i * (n - 1) / F.lit(slots - 1)).cast("int")))
    return F.when(n <= slots, all_).otherwise(spread)


def chosen_groups(section_rows: DataFrame, key: str = "evidence_id") -> DataFrame:
    """The groups of sections to extract from a document: all within one group's size, else up to six, half of them kept for questions.

    Returns (key, section_id, kind, grp) of the chosen sections."""
    docs = section_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "section_id", "kind", "n_chars"))).alias("s"))
    pick = lambda q: F.filter("s", lambda x: (x["kind"] == "qa") == F.lit(q))
    docs = docs.withColumn("qa", pick(True)).withColumn("rest", pick(False)).withColumn("total", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"]))
    for c in ("qa", "rest"):
        docs = docs.withColumn(f"{c}_g", greedy_groups(F.transform(c, lambda x: x["n_chars"]), GROUP_CHARS))
        docs = docs.withColumn(f"{c}_n", F.coalesce(F.try_element_at(f"{c}_g", F.lit(-1)), F.lit(0)))
    half = max(2, MOST_GROUPS // 2)
    qa_take = F.when(F.col("total") <= GROUP_CHARS, even_sample(F.col("qa_n"), 10**6)).otherwise(F.when(F.col("qa_n") <= half, even_sample(F.col("qa_n"), half)).otherwise(even_sample(F.col("qa_n"), half)))
    taken = F.least(F.col("qa_n"), F.lit(half))
    rest_take = F.when(F.col("total") <= GROUP_CHARS, even_sample(F.col("rest_n"), 10**6))
    for k in range(half + 1):
        rest_take = rest_take.when(taken == k, even_sample(F.col("rest_n"), MOST_GROUPS - k))
    docs = docs.withColumn("qa_t", qa_take).withColumn("rest_t", rest_take)
    out = None
    for c in ("rest", "qa"):
        one = docs.select(key, F.lit(c).alias("part"), f"{c}_t", F.explode(F.arrays_zip(F.col(c).alias("x"), F.col(f"{c}_g").alias("g"))).alias("z")).where(F.array_contains(f"{c}_t", F.col("z.g") - 1))
        one = one.select(key, F.col("z.x.section_id").alias("section_id"), F.col("z.x.kind").alias("kind"), F.col("part"), F.col("z.g").alias("grp"))
        out = one if out is None else out.unionAll(one)
    return out


def bounded_join(parts: Column, most: int) -> Column:
    """Texts joined by blank lines up to a budget; the last is cut to what is left of it."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        left = F.lit(most) - acc["used"]
        some = F.substring(p, F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
        return F.when((F.length(p) == 0) | (left <= 0), acc).otherwise(F.struct((acc["used"] + F.length(some) + 2).alias("used"), F.concat(acc["out"], F.array(some)).alias("out")))

    return F.substring(F.aggregate(F.transform(parts, lambda x: F.trim(x)), zero, step, lambda acc: F.array_join(acc["out"], "\n\n")), 1, most)


def best_pages(pages: Column, k: int, always: int) -> Column:
    """Indices from 0 of the k pages of highest score, the earlier of equals, and of the first `always` pages, in page order."""
    scored = F.transform(pages, lambda p, i: F.struct((-text.page_score(p)).alias("s"), i.alias("i")))
    top = F.transform(F.slice(F.array_sort(scored), 1, k), lambda x: x["i"])
    first = F.filter(F.sequence(F.lit(0), F.lit(max(0, always - 1))), lambda i: (i < F.size(pages)) & F.lit(always > 0))
    return F.array_sort(F.array_distinct(F.concat(top, first)))


def _paged(pages: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.concat(F.lit("[[PAGE "), (i + 1).cast("string"), F.lit("]]\n"), F.element_at(pages, i + 1)))


def compress_document(pages: Column, most: int = 24_000) -> Column:
    return bounded_join(_paged(pages, best_pages(pages, 8, 1)), most)


def compress_deck(pages: Column, most: int = 30_000) -> Column:
    return bounded_join(_paged(pages, best_pages(pages, 10, 2)), most)


def compress_call(pages: Column, most: int = 46_000) -> Column:
    """Questions and answers first, with 68 percent of the budget, then the best pages before them; without a heading, the last third counts as questions."""
    n = F.size(pages)
    marked = F.array_position(F.transform(pages, lambda p: text.contains_any(F.lower(p), text.QA_MARKERS)), True)
    start = F.when(marked > 0, marked - 1).otherwise(F.greatest(F.lit(1), n - F.greatest(F.lit(4), F.floor(n / 3)))).cast("int")
    asked = F.when(start < n, F.sequence(start, n - 1)).otherwise(F.array().cast("array<int>"))
    before = F.slice(pages, 1, start)
    qa_budget = int(most * 0.68)
    return bounded_join(F.array(bounded_join(_paged(pages, asked), qa_budget), bounded_join(_paged(pages, best_pages(before, 5, 1)), most - qa_budget)), most)


def compress_text(content: Column, most: int = 24_000) -> Column:
    """The paragraphs and sentences of a text that hold a signal word, within a budget; the text itself where none does."""
    clean = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\n{3,}", "\n\n"))
    told = F.filter(text.sentences(clean), lambda x: text.contains_any(F.lower(x), text.SIGNAL_TERMS))
    return bounded_join(F.when(F.size(told) > 0, told).otherwise(F.array(clean)), most)


def compress(content: Column, kind: Column, title: Column) -> Column:
    """A text in short by its kind or its title: calls with their questions first, in pages of a dozen paragraphs; other texts by their sentences."""
    probe = F.lower(F.concat_ws(" ", F.coalesce(kind, F.lit("")), F.coalesce(title, F.lit(""))))
    call = F.coalesce(kind.isin("transcript", "qa", "prepared_remarks"), F.lit(False)) | text.contains_any(probe, CALL_HINTS)
    return F.when(call, compress_call(pseudo_pages(content))).otherwise(compress_text(content))


def unit_payload(unit_rows: DataFrame, evidence: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Units as an extraction model gets them: nine fields, empty where they are unknown."""
    docs = evidence.select(key, "document_key", "title", F.coalesce("metadata.source", F.lit("")).alias("source"), F.coalesce("metadata.document_kind", F.lit("")).alias("document_kind"))
    rows = unit_rows.join(docs, key)
    return rows.select("unit_id", "document_key", F.coalesce("title", F.lit("")).alias("title"), "source", "document_kind", F.coalesce("phase", F.lit("")).alias("phase"), F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("unit", F.lit("")).alias("text"), F.lit("").alias("related_official_context"))


def pseudo_pages(content: Column, size: int = 12) -> Column:
    """A text's paragraphs, a dozen to a page."""
    p = text.paragraphs(content)
    numbers = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.array_join(F.slice(p, i * size + 1, F.lit(size)), "\n\n"))
