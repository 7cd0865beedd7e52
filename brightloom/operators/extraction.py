"""Models behind narrow interfaces, and the stage that calls one for every batch of units.

The engine itself calls no network: `RuleClient` is a deterministic client by rules, and others have the same methods. The stage calls a client once for each
batch in Arrow batches, calls it again for units that it left out, each alone, and tells which units are covered; cards whose quote isn't in their unit are told apart.

Defined cases: units without text give no card and count as processed; a unit named by no call is missing; cards of unknown units are dropped; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.text import SIGNAL_TERMS
from brightloom.operators.unitize import coverage
from brightloom.session import stored

CARD = "unit_id string, card_type string, topic string, statement string, metric string, quote string"


class AnalysisClient(Protocol):
    """What an analysis needs of a model. Units are dicts of unit_id and text; cards are dicts of the fields in CARD."""

    def extract(self, units: list[dict]) -> tuple[list[str], list[dict]]:
        """The ids of the units that were processed, and the cards found in them."""

    def analyse(self, cards: list[dict]) -> str: ...

    def audit(self, report: str, cards: list[dict]) -> dict: ...

    def revise(self, report: str, audit: dict) -> str: ...

    def is_update(self, previous: int, current: int) -> bool: ...


class ResearchClient(Protocol):
    """What a search for a company's documents needs of a model: an answer as text, to be read by evidence.grounded_sources."""

    def research(self, ticker: str, event_id: str) -> str: ...


class RuleClient:
    """A client by rules: a card for each sentence with a signal word and a number. Reports list statements; audits compare them with the cards."""

    ends = re.compile(r"(?:\n[ \t\n\x0b\f\r]*\n|(?<=[.!?])[ \t\n\x0b\f\r]+)")

    def extract(self, units: list[dict]) -> tuple[list[str], list[dict]]:
        cards = []
        for u in units:
            for said in self.ends.split(u["text"] or ""):
                said, low = said.strip(" "), said.lower()
                term = next((t for t in SIGNAL_TERMS if t in low), None)
                if term and any("0" <= c <= "9" for c in said):
                    kind = "guidance" if term in ("guidance", "outlook") else "fact"
                    cards.append({"unit_id": u["unit_id"], "card_type": kind, "topic": "guidance" if kind == "guidance" else "other", "statement": said, "metric": term, "quote": said})
        return [u["unit_id"] for u in units], cards

    def analyse(self, cards: list[dict]) -> str:
        return "\n".join(f"• {s}" for s in dict.fromkeys(c["statement"] for c in cards))

    def audit(self, report: str, cards: list[dict]) -> dict:
        known = {c["statement"] for c in cards}
        return {"unsupported_claims": [s for line in report.split("\n") if (s := line.removeprefix("• ").strip()) and s not in known]}

    def revise(self, report: str, audit: dict) -> str:
        bad = set(audit["unsupported_claims"])
        return "\n".join(line for line in report.split("\n") if line.removeprefix("• ").strip() not in bad)

    def is_update(self, previous: int, current: int) -> bool:
        return current > previous


def _called(batches: DataFrame, client: AnalysisClient) -> DataFrame:
    """A row for each unit that the client processed (processed true), and one for each card."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CARD.split(", ")]
        for pdf in parts:
            rows = []
            for ids, texts in zip(pdf["ids"], pdf["texts"]):
                done, cards = client.extract([{"unit_id": i, "text": t} for i, t in zip(ids, texts)])
                rows += [{"processed": True, "unit_id": i} for i in done] + [{"processed": False, **{n: c.get(n) for n in names}} for c in cards]
            yield pd.DataFrame(rows, columns=["processed", *names])

    return batches.select("ids", "texts").mapInPandas(run, f"processed boolean, {CARD}")


def extract_cards(units: DataFrame, batch: DataFrame, client: AnalysisClient) -> tuple[DataFrame, DataFrame]:
    """(cards, coverage) of units by a client. units: document_key, unit_id, unit. batch: unit_id and its batch's columns, as unitize.batches gives them.

    Cards have `backed`, whether their quote is in their unit but for white space at its ends. Coverage is a row a document."""
    by = [c for c in batch.columns if c not in ("unit_id", "position")]
    item = F.struct("position", "unit_id", "unit")
    grouped = units.join(batch, "unit_id").groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("u"))  # a batch is bounded in units and characters
    first = stored(_called(grouped.select(F.transform("u", lambda x: x["unit_id"]).alias("ids"), F.transform("u", lambda x: x["unit"]).alias("texts")), client), "first_calls")
    left = units.join(first.where("processed").select("unit_id"), "unit_id", "left_anti")
    again = stored(_called(left.select(F.array("unit_id").alias("ids"), F.array("unit").alias("texts")), client), "second_calls")
    every = first.unionByName(again)
    known = units.select("unit_id", "document_key", "unit")
    cards = every.where("NOT processed").drop("processed").join(known, "unit_id")
    backed = (F.trim(F.coalesce("quote", F.lit(""))) != "") & F.contains(F.coalesce("unit", F.lit("")), F.trim("quote"))
    done = every.where("processed").select("unit_id").join(known.select("unit_id", "document_key"), "unit_id")
    return cards.withColumn("backed", F.coalesce(backed, F.lit(False))).drop("unit"), coverage(units, done, ["document_key"])
