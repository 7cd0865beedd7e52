import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.llm import chunks

SMALL = chunks.Rule(most=60, overlap=8, least=20, window=4, every=16, reach=12)


def check(text, rule):
    spans, hard, runs = chunks.cut(text, rule)
    every = list(map(len, re.split("[" + "".join(re.escape(chr(c)) for c in chunks.WHITE + chunks.ENDS) + "]", text)))
    assert len(runs) == sum(hard) and set(runs) <= set(every) and (max(runs, default=0) > rule.most) == (max(every) > rule.most)
    if not text:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= rule.most for a, b in spans)
    assert all(b2 == a1 - rule.overlap or b2 == 0 for (_, a1), (b2, _) in zip(spans, spans[1:]))
    rebuilt = text[: spans[0][1]] + "".join(text[e : f] for (_, e), (_, f) in zip(spans, spans[1:]))
    assert rebuilt == text
    for (a, b), h in zip(spans[:-1], hard):
        if not h:
            assert ord(text[b - 1]) in chunks.WHITE + chunks.ENDS
        else:  # no boundary was within reach
            assert all(ord(c) not in chunks.WHITE + chunks.ENDS for c in text[a + rule.overlap : b] if a or True) or not set(text[max(a, b - rule.most + rule.overlap) : b]) & {chr(c) for c in chunks.WHITE + chunks.ENDS} - set(text[: a + rule.overlap])


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n。　\U0001f600", max_size=400))
def test_pieces_rebuild_the_text(text):
    check(text, SMALL)


@pytest.mark.parametrize("text", ["x" * 9000, "word " * 4000, "あ" * 4001, "a" * 3999 + ".", "one. " * 799 + "y" * 4500, "\r\n\r\n".join(["p" * 300] * 60), "x" * 4000])
def test_production_rule(text):
    check(text, chunks.Rule())


def test_blocks_agree(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefg .\n") for _ in range(30_000))
    whole = chunks.cut(text)
    monkeypatch.setattr(chunks, "_BLOCK", 1000)
    assert chunks.cut(text) == whole


def test_an_edit_alters_neighbours_only():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", "."]) for _ in range(12_000))
    before = {text[a:b] for a, b in chunks.cut(text)[0]}
    for at in (10, 20_000, 40_000):
        edited = text[:at] + "inserted " + text[at:]
        new = [edited[a:b] for a, b in chunks.cut(edited)[0]]
        assert sum(p not in before for p in new) <= 4


def test_tables(spark):
    rows = [(1, "x" * 5000, 9), (2, "short", 9), (3, None, 9), (4, "", 9), (5, "w " * 2001, 9), (5, "w " * 2001, 9)]
    df = spark.createDataFrame(rows, "evidence_id long, text string, piece int")
    found = sorted((r["evidence_id"], r["hard_cut"]) for r in chunks.oversized(df, "evidence_id").collect())
    assert found == [(1, 1), (5, 0), (5, 0)]
    got = chunks.pieces(df, "evidence_id").where("evidence_id = 1").orderBy("piece_no").collect()
    assert [len(r["piece"]) for r in got] == [r["end_char"] - r["start_char"] for r in got] and got[-1]["end_char"] == 5000
    assert chunks.pieces(df.limit(0), "evidence_id").count() == 0
    whole = chunks.rebuilt(chunks.pieces(df.where("evidence_id = 1"), "evidence_id"), "evidence_id").first()
    assert whole["digest"] == hashlib.sha256(b"x" * 5000).hexdigest() and whole["chars"] == 5000 and whole["within"] and whole["shared"] and whole["natural"]
    bad = chunks.pieces(df.where("evidence_id = 1"), "evidence_id").withColumn("hard", F.lit(False))
    assert not chunks.rebuilt(bad, "evidence_id").first()["natural"]
    assert chunks.rebuilt(chunks.pieces(df.limit(0), "evidence_id"), "evidence_id").count() == 0
