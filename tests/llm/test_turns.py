import numpy as np
import pytest

from brightloom.llm import turns
from brightloom.llm.roster import Roster, distance

PEOPLE = [
    (1, None, "Operator", "Operator", None), (10, "T", "Dorrit Verulund", "Chief Executive Officer", "Talco"), (11, "T", "Joss Ostentris", "Chief Financial Officer", "Talco"),
    (20, "U", "Rask Verulmont", "Chief Executive Officer", "Umco"), (30, None, "Hesper Vethwen", "Analyst", "Orane & Co."), (31, None, "Anselm Brildane", "Analyst", "Pelav Research"), (32, None, "Maria del Carmen de la Vega Ruiz", "Analyst", "Orane & Co."),
]
ROSTER = Roster(PEOPLE)
CLEAN = turns.Cleaner(["um", "uh", "uhm", "er", "erm", "ah", "hmm"], ["you know", "I mean", "sort of", "kind of"])
MODEL = turns.SemiMarkov()


@pytest.mark.parametrize("label,who", [
    ("Dorrit Verulund", 10), ("VERULUND,  DORRIT", 10), ("D. Verulund", 10), ("Verulund", 10), ("Dorit Verulnud", 10), ("CEO", 10), ("ceo Verulund", 10), ("Chief Financial Officer", 11),
    ("Joss\xa0Ostentris – Chief Financial Officer", 11), ("Ostentris, Joss (CFO)", 11), ("Analyst - Pelav Research", 31), ("Orane & Co. - Hesper Vethwen", 30), ("Hesper Vethwen (Orane & Co.)", 30),
    ("Conference Operator", 1), ("moderator", 1), ("Two points", None), ("Guidance", None), ("", None), (None, None), ("x" * 500, None), ("COO", None), ("Analyst", None), ("Dorrit Verulund (" + "Chief Executive Officer and Chair of the Board of Directors, " * 5 + ")", 10), ("Maria del Carmen de la Vega Ruiz", 32), ("Ruiz, Maria del Carmen de la Vega", 32), ("Maria del Carmen de la Vega", None), ("The next question is from Anselm (07:09) Brildane.", None),
])
def test_labels(label, who):
    assert ROSTER.resolve("T", label)[0] == who


def test_roles_are_of_the_company():
    assert ROSTER.resolve("U", "CEO")[0] == 20 and ROSTER.resolve(None, "CEO")[0] is None


def test_distance():
    assert distance("verulund", "verulnud", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2


def of(text):
    return [(s, said) for s, _, said, _ in turns.turns(text, "T", ROSTER, CLEAN, MODEL)]


SAID = [(1, "Welcome all."), (10, "Thank you. Sales rose. Two points: costs fell."), (30, "Why did costs fall?"), (11, "Mix.")]
LAYOUTS = [
    "Edited: not a turn\n\nOperator: Welcome all.\n\nDorrit Verulund: Thank you.\n\nDorrit Verulund (CEO): Sales rose.\n\nTwo points: costs fell.\n\nHesper Vethwen: Why did costs fall?\n\nCFO: Mix.",
    "[00:00:01] Operator: Welcome all.\n\n[00:00:05] Verulund: Thank you. Sales rose.\n\nTwo points: costs fell.\n\n[00:01:05] CFO: Mix.\n\n[00:00:50] Analyst - Hesper Vethwen: Why did costs fall?",
    "00:00:01 OPERATOR >> Welcome all.\n00:00:03 DORRIT VERULUND >> Thank you.\n00:00:04 D. VERULUND >> Sales rose. Two points: costs fell.\n00:00:05 VETHWEN, HESPER >> Why did costs fall?\n00:00:06 JOSS OSTENTRIS >> Mix.",
    "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.000\r\n<v Operator>Welcome all.\r\n\r\n2\r\n00:00:03.000 --> 00:00:04.000\r\n<v Dorrit Verulund>Thank you. Sales rose.\r\n\r\n3\r\n00:00:05.000 --> 00:00:06.000\r\n<v CEO>Two points: costs fell.\r\n\r\n4\r\n00:00:09.000 --> 00:00:10.000\r\n<v CFO>Mix.\r\n\r\n5\r\n00:00:07.000 --> 00:00:08.000\r\n<v Vethwen>Why did costs fall?",
    "OPERATOR\n(00:00:01)\nWelcome all.\n\nDorrit Verulund\n(00:00:02)\nThank you. Sales rose.\n\nTwo points: costs fell.\n\nHesper Vethwen (Orane & Co.)\n(00:00:04)\nWhy did costs fall?\n\nCFO\n(00:00:09)\nMix.",
    "Moderator\n\nWelcome all.\n\nDorrit Verulund\n\nThank you. Sales rose.\n\nTwo points: costs fell.\n\nHesper Vethwen\n\nWhy did costs fall?\n\nChief Financial Officer\n\nMix.",
]


@pytest.mark.parametrize("text", LAYOUTS)
def test_layouts(text):
    assert of(text) == SAID


@pytest.mark.parametrize("raw,clean,n", [
    ("We, ummm, sold [laughter] 5 units (as reported).", "We, sold 5 units (as reported).", 6), ("You know, it rose", "it rose", 2), ("The kind of demand we see, kind of, fell", "The kind of demand we see, fell", 7),
    ("As you know, it (01:44) fell ♪ <crosstalk> *coughs* ((phone rings)) {background music}", "As you know, it fell", 5), ("(as [inaudible 00:01:02] reported) [End of call]", "(as reported)", 2), ("(as, Um... reported) uh— so", "(as, reported) so", 3), ("[00:01:02]", "", 0),
    ("It was *very* (excluding currency) good — really", "It was *very* (excluding currency) good — really", 7), ("Um", "", 0), ("", "", 0),
])
def test_cleaning(raw, clean, n):
    got = CLEAN.clean(raw)
    assert got == clean and turns.count_words(got) == n


def test_blocks_without_words_are_dropped():
    assert of("Operator: Hello.\n\nCEO: (inaudible)\n\nOperator: Uh, [laughter]\n\nOperator: Bye.") == [(1, "Hello. Bye.")]
    assert of("") == of(None) == of("no speaker here") == of("  \n ") == []


def test_long_labels_and_headings():
    role = "Chief Executive Officer and Chair of the Board of Directors of all of the companies of the group, " * 3
    assert len(role) > 280
    for layout in (f"Operator: Welcome all.\n\nDorrit Verulund ({role}): Thank you. Sales rose.\n\nOperator: Bye.", f"Operator\n\nWelcome all.\n\nDorrit Verulund ({role})\n\nThank you. Sales rose.\n\nOperator\n\nBye.",
                   f"00:00:01 OPERATOR >> Welcome all.\n00:00:03 DORRIT VERULUND ({role.upper()}) >> Thank you. Sales rose.\n00:00:09 OPERATOR >> Bye."):
        assert of(layout) == [(1, "Welcome all."), (10, "Thank you. Sales rose."), (1, "Bye.")]
    said = "We saw in this quarter, as in the one before, what customers of all kinds and sizes everywhere had told us they would do next: they bought."
    assert of(f"Operator: Welcome all.\n\nDorrit Verulund: {said}\n\n{said}\n\nOperator: Bye.") == [(1, "Welcome all."), (10, f"{said} {said}"), (1, "Bye.")]


def test_long_notes():
    note = "background music and applause " * 20
    assert len(note) > 500
    for a, b in ("()", "[]", "{}", "<>", "**", ("((", "))")):
        assert CLEAN.clean(f"It rose {a}{note}{b} again") == "It rose again"
    deep = "[laughter " * 12 + "]" * 12
    assert CLEAN.clean(f"It rose {deep} again") == "It rose again"
    kept = "(" + "excluding the effects of currency " * 20 + ")"
    assert turns.count_words(CLEAN.clean(f"It rose {kept} again")) == 3 + 5 * 20
    assert CLEAN.clean("(" * 20_000 + "x").endswith("x")


def test_no_word_is_lost_of_very_many_lines():
    lines = [f"Line {k} is short" + (" [applause]" if k % 7 == 0 else "") for k in range(100_000)]
    text = "\n".join(["Operator: Welcome all.", "Dorrit Verulund: Thank you.", *lines, "", "Operator: Bye."])
    got = of(text)
    assert [s for s, _ in got] == [1, 10, 1] and turns.count_words(got[1][1]) == 2 + 4 * 100_000


@pytest.mark.parametrize("n", [300, 2000])
def test_long_turns_of_short_lines(n):
    lines = [f"Line {k} is short." for k in range(n)]
    text = "\n\n".join(["Operator: Welcome all.", "Dorrit Verulund: Thank you.", *lines, "Hesper Vethwen: Why did costs fall?", "CFO: Mix."])
    assert of(text) == [(1, "Welcome all."), (10, " ".join(["Thank you.", *lines])), (30, "Why did costs fall?"), (11, "Mix.")]


def test_decoding_is_the_best_of_all_segmentations():
    rng = np.random.default_rng(5)
    for n, far in ((700, 0), (1100, 300), (1100, 800)):
        x = rng.normal(-1, 1, (n, len(turns.FEATURES)))
        x[1 : far + 1, -1] = -30
        words = np.append(0, np.cumsum(rng.integers(0, 3, n)))
        m = turns.SemiMarkov(np.append(rng.normal(0, 1, len(turns.FEATURES)), rng.normal(0, 2, 3)))
        m.weights[len(turns.FEATURES) - 1] = 1
        start, best, back = x @ m.weights[: len(turns.FEATURES)], np.zeros(n + 1), np.full(n + 1, -1)
        for j in range(1, n + 1):
            t = best[:j] + start[:j] + m.segments(words, np.arange(j), j) @ m.weights[len(turns.FEATURES) :]
            if t.max() > 0:
                best[j], back[j] = t.max(), t.argmax()
        want, j = [], n
        while j > 0 and back[j] >= 0:
            want, j = [int(back[j]), *want], int(back[j])
        assert m.decode(x, words) == want


def test_pauses_and_shared_words_are_features():
    doc = turns.units("[00:00:01] Operator: Welcome to the quarterly call.\n[00:00:31] CFO: Quarterly margins rose.\nCEO: Mix.\n[00:00:20] Operator: Bye.")
    x = turns.features(doc, "T", ROSTER)[1]
    assert x[:, turns.FEATURES.index("gap")].round(3).tolist() == [0, 3.434, 0, 0]
    assert x[:, turns.FEATURES.index("shared")].round(3).tolist() == [0, 0.333, 0, 0]
    bare = turns.training_rows([(LAYOUTS[2], "T")], ROSTER)[1][0]
    assert not bare[:, turns.FEATURES.index("gap")].any()


def test_training_raises_the_likelihood():
    data = turns.training_rows([(t, "T") for t in LAYOUTS[1:5]], ROSTER)
    assert data
    of_data = lambda m: sum(m.gradient(*d)[0] for d in data)
    before = of_data(turns.SemiMarkov())
    assert of_data(turns.SemiMarkov().fit(data, rounds=15)) > before


def test_both_ways_of_summing_agree():
    for x, words, truth in turns.training_rows([(t, "T") for t in LAYOUTS[1:5]], ROSTER):
        m = turns.SemiMarkov()
        a, b = m.gradient(x, words, truth), m.gradient(x, words, truth, list(m.spans(words, truth)))
        assert abs(a[0] - b[0]) < 1e-9 and abs(a[1] - b[1]).max() < 1e-9


def test_gradient_is_the_slope():
    x, words, truth = turns.training_rows([(LAYOUTS[2], "T")], ROSTER)[0]
    m = turns.SemiMarkov()
    g = m.gradient(x, words, truth)[1]
    for k in (0, 6, 9, len(turns.FEATURES) + 1):
        w = turns.DEFAULT.copy()
        w[k] += 1e-5
        assert abs((turns.SemiMarkov(w).gradient(x, words, truth)[0] - m.gradient(x, words, truth)[0]) / 1e-5 - g[k]) < 1e-3


def test_tables(spark):
    people = spark.createDataFrame(PEOPLE, "speaker_id long, ticker string, full_name string, role string, firm string")
    evidence = spark.createDataFrame([(1, "s:1", LAYOUTS[0], ("transcript",), "x"), (2, "s:2", None, ("transcript",), "x"), (3, "s:1", LAYOUTS[0], ("filing",), "x"), (4, None, LAYOUTS[0], ("transcript",), "x")],
        "evidence_id long, document_key string, text string, metadata struct<document_kind: string>, ticker string")
    disclosures = spark.createDataFrame([("s", "1", "T"), ("s", "1", None), ("s", "1", "T")], "source string, source_id string, ticker string")
    scripts = turns.with_company(evidence, disclosures)
    roster = turns.roster_of(people)
    got = turns.speaker_turns(scripts, roster, CLEAN, turns.trained(scripts, roster)).orderBy("evidence_id", "turn_no").collect()
    assert [(r["speaker_id"], r["said"]) for r in got if r["evidence_id"] == 1] == SAID
    assert {r["evidence_id"] for r in got} == {1, 4}
    cards = spark.createDataFrame([(5, "T", "CEO", None), (6, "T", "nobody", "D. Verulund")], "card_seq long, ticker string, speaker string, management_speaker string")
    rows = {(r["record_kind"], r["record_id"]): r["speaker_id"] for r in turns.card_speakers(cards, roster).collect()}
    assert rows == {("speaker", 5): 10, ("speaker", 6): None, ("management_speaker", 6): 10}
    assert turns.speaker_turns(scripts.limit(0), roster, CLEAN, MODEL).count() == 0


def test_too_many_fillers_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(turns, "MOST_FILLERS", 3, raising=False)
    fillers = lambda n: spark.range(n).selectExpr("concat('um', id) AS term", "'sound' AS kind")
    assert len(turns.cleaner_of(fillers(3)).sounds) == 3
    with pytest.raises(ValueError):
        turns.cleaner_of(fillers(4))
