"""Items of varying length packed into containers of fixed capacity, balanced by attention cost.

The cost of an item is linear plus quadratic in its tokens. Items are spread at random over cells of bounded size, and
in each cell, items in descending order go to the container of least cost with capacity left for them; those that an item
fills to the last token come before others. A cell starts with the
fewest containers that its tokens allow, and opens another only for an item that fits in none. An item
that alone exceeds the capacity is split into full containers and a rest, which is packed like any item.

Cells are as many as the items need: no task holds more than some multiple of `cell` items, whatever the number of
items is, and a cell leaves less than one container's capacity unused where its items are small.

Defined cases: empty and null texts are items of no tokens and are assigned like others; equal lengths are ordered by key;
repeated keys are separate items; a capacity of null or under 1 gives no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm import tokens
from brightloom.session import stored

#: items of a cell on average.
CELL = 16_384
#: weight of the quadratic (attention) part of an item's cost against the linear part: at n tokens, cost n + n * n / QUADRATIC.
QUADRATIC = 2048.0


def cost(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.float64)
    return n + n * n / QUADRATIC


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes are descending and within the capacity."""
    n, total = len(sizes), int(sizes.sum())
    start = max(1, -(-total // capacity), int((sizes * 2 > capacity).sum()))
    left = np.full(n + start, capacity, np.int64)
    costs = np.full(n + start, np.inf)
    costs[:start] = 0.0
    opened, out, price = start, np.zeros(n, np.int64), cost(sizes)
    smallest = int(sizes[-1]) if n else 0
    live = np.arange(start)  # containers with room for the smallest item, so that full ones are not looked at again
    for i in range(n):
        room = left[live]
        exact = room == sizes[i]
        fits = exact if exact.any() else room >= sizes[i]
        masked = np.where(fits, costs[live], np.inf)
        j = int(masked.argmin()) if len(live) else -1
        if j < 0 or masked[j] == np.inf:
            c, opened = opened, opened + 1
            costs[c] = 0.0
            live = np.append(live, c)
        else:
            c = int(live[j])
        out[i] = c
        left[c] -= sizes[i]
        costs[c] += price[i]
        if left[c] < smallest or (left[c] == 0 and smallest):
            live = live[live != c]
    return out


def pack(items: DataFrame, key: str, size: str, capacity: str, by: list[str], cell: int = CELL) -> DataFrame:
    """(by, container, key, part, from_token, n_tokens): items have their size and the capacity that holds for them.

    by: columns of one packing, such as a spec's id. container numbers are unique in a packing."""
    rows = items.select(*by, F.col(key).cast("string").alias("_key"), F.col(size).cast("long").alias("_n"), F.col(capacity).cast("long").alias("_cap")).where("_cap > 0 AND _n IS NOT NULL")
    counts = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_items")).withColumn("_cells", F.ceil(F.col("_items") / cell)).select(*by, "_cells"), "cells")  # a row a packing
    total = counts.agg(F.sum("_cells")).first()[0] or 1
    celled = rows.join(F.broadcast(counts), by).withColumn("_cell", F.pmod(F.xxhash64("_key", *by), F.col("_cells")))
    celled = celled.repartition(int(total), *by, "_cell")  # as many tasks as cells, whatever their bytes
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "container long", f"{key} string", "part int", "from_token long", "n_tokens long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_len=pdf["_key"].str.len()).sort_values(["_n", "_len", "_key"], ascending=[False, True, True], kind="stable")  # of whole numbers, their order
        cap, n = int(pdf["_cap"].iloc[0]), pdf["_n"].to_numpy()
        full = n // cap * (n > cap) - ((n > cap) & (n % cap == 0))  # full containers of an oversized item; its rest is 1..capacity
        rest = n - full * cap
        order = np.argsort(-rest, kind="stable")
        where = np.empty(len(n), np.int64)
        where[order] = assign(rest[order], cap)
        base = int(where.max()) + 1 if len(n) else 0
        k = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(full) - full, full)
        keys = pdf["_key"].to_numpy()
        out = pd.DataFrame({
            "container": np.concatenate([base + np.arange(len(k)), where]), key: np.concatenate([keys[k], keys]),
            "part": np.concatenate([nth + 1, full + 1]), "from_token": np.concatenate([nth * cap, full * cap]), "n_tokens": np.concatenate([np.full(len(k), cap), rest]),
        })
        out["container"] += int(pdf["_cell"].iloc[0]) << 32
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "container", key, "part", "from_token", "n_tokens"]]

    packed = celled.groupBy(*by, "_cell").applyInPandas(run, schema)
    return packed.select(*by, "container", F.col(key).cast(kinds[key]).alias(key), "part", "from_token", "n_tokens")


def pack_texts(documents: DataFrame, specs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZERS, cell: int = CELL) -> DataFrame:
    """Every document in the containers of every spec (spec_id, tokenizer, capacity_tokens)."""
    names = sorted(r[0] for r in specs.select("tokenizer").where("tokenizer IS NOT NULL").distinct().collect())  # a few vocabularies by name
    sized = None
    for name in names:
        one = tokens.lengths(documents, key, text, name, folder).withColumn("tokenizer", F.lit(name))
        sized = one if sized is None else sized.unionByName(one)
    if sized is None:
        sized = documents.select(key).where("false").withColumn("n_tokens", F.lit(0).cast("long")).withColumn("tokenizer", F.lit(None).cast("string"))
    sized = stored(sized, "token_lengths")
    items = sized.join(specs.select("spec_id", "tokenizer", "capacity_tokens"), "tokenizer")
    return pack(items, key, "n_tokens", "capacity_tokens", ["spec_id"], cell)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """A row a spec: containers, parts, tokens, the least number of containers that the tokens allow, and the share of unused room."""
    by_container = packed.groupBy("spec_id", "container").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("tokens"))
    per = by_container.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("parts").alias("parts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    out = per.join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "spec_id")  # as many rows as specs on either side
    room = F.col("containers") * F.col("capacity_tokens")
    return out.select("spec_id", "containers", "parts", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(1 - F.col("tokens") / room, 6).alias("unused"))
