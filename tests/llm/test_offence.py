import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import offence
from brightloom.session import table

#: tables with labels, and the least recall on a quarter of them when half are fitted: some 700 cases in the larger, 130 in the smaller, which are too few for rare words
TABLES = {"/root/testdata/check_l": 0.95, "/root/testdata/sf0.1": 0.55}

INSULT = ["you are a rotten scumbag", "drop dead you moron", "what a pathetic halfwit you are"]
PLAIN = ["the rotten crate was returned", "revenue rose in the quarter", "margins held steady in japan", "the board approved a dividend", "drop in orders was small"]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        s = rng.choices(PLAIN, k=6)
        bad = i % 4 == 0
        if bad:
            s.insert(rng.randrange(6), rng.choice(INSULT))
        texts.append(". ".join(s) + ".")
        labels.append({"abusive"} if bad else set())
    return texts, labels


def test_held_out():
    m = offence.train(*corpus(240, 1))
    texts, labels = corpus(200, 2)
    got = [m.score(t)[0] >= offence.THRESHOLD for t in texts]
    assert got == [bool(x) for x in labels]
    assert m.score("Y o u are a r.o.t.t.e.n scuuuumbag")[0] >= offence.THRESHOLD
    assert m.score(None)[0] == 0 and m.score("  ")[0] == 0
    long = ". ".join(PLAIN * 12_000)
    assert m.score(long)[0] < offence.THRESHOLD <= m.score(long + ". " + INSULT[0])[0]
    assert (m.score(texts[0])[1:] < 1e-6).all()  # no case of the other categories was labelled


def test_no_labels():
    assert (offence.train([], []).score("anything at all") < 1e-6).all()


@pytest.mark.parametrize("a,b", [("m0r0n", "moron"), ("scuuumbag", "scumbag"), ("а" + "sshole", "asshole"), ("a#####e", "a***e"), ("$tup1d", "stupid")])
def test_word_forms(a, b):
    assert offence.word_form(a) == offence.word_form(b)


def test_tables(spark):
    texts, labels = corpus(120, 3)
    docs = spark.createDataFrame([(i, t, None if i % 3 else "s", 0.5) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, source string, abusive double")
    marks = spark.createDataFrame([(i, "abusive" if x else "none", "r") for i, x in enumerate(labels)], "doc_id long, category string, annotator string")
    got = offence.labelled(docs, marks).collect()
    assert len(got) == 120 and sum(bool(r["cats"]) for r in got) == 30
    assert offence.labelled(docs, marks, 5, 7).count() == 12
    words = offence.hashed(offence.labelled(docs, marks))
    assert words.count() == 120 and {r["doc_id"]: r["n"] for r in words.collect()} == {i: len(offence.terms(t)) for i, t in enumerate(texts)}
    assert 0 < offence.hashed(offence.labelled(docs, marks), 1000).agg({"n": "sum"}).first()[0] <= 1000
    m, here = offence.train_on(words), offence.train(texts, labels)
    assert abs(m.scores(texts) - here.scores(texts)).max() < 1e-4
    assert (offence.train_on(words.limit(0)).scores(["x y"]) < 1e-6).all()
    scored = offence.score(docs, m, ["doc_id", "source"])
    assert {r["doc_id"] for r in offence.cases(scored).collect()} == {i for i, x in enumerate(labels) if x}
    rates = {(r["source"], r["category"]): r for r in offence.rates(scored).collect()}
    assert rates[("s", "abusive")]["documents"] == 41 and len(rates) == 6
    assert offence.cases(offence.score(docs.limit(0), m, ["doc_id"])).count() == 0


def plain_logits(m, text):
    """Every window's sum of weights and of products of factors, pair by pair."""
    one, two = offence.slots(offence.terms(text))
    out = []
    for a, b in zip(*offence.windows(len(one))):
        k = [*one[a:b], *two[a + 1 : b]]
        out.append([m.bias[c] + sum(m.weight[i, c] for i in k) + sum(m.factor[k[i], c] @ m.factor[k[j], c] for i in range(len(k)) for j in range(i)) for c in range(len(m.bias))])
    return np.array(out).max(axis=0)


def test_scores_are_the_machine_s():
    rng = np.random.default_rng(3)
    size = (1 << offence.BITS) + 1
    weight, factor = rng.normal(0, 0.3, (size, 3)).astype("f4"), rng.normal(0, 0.1, (size, 3, offence.FACTORS)).astype("f4")
    weight[-1] = factor[-1] = 0
    m = offence.Machine(rng.normal(0, 1, 3), weight, factor)
    texts = [" ".join(f"w{rng.integers(40)}x" for _ in range(n)) for n in (1, 2, 13, 14, 15, 16, 17, 18, 19, 21, 22, 40, 41)]
    want = np.array([1 / (1 + np.exp(-plain_logits(m, t))) for t in texts])
    assert abs(m.scores([*texts, None, ""])[: len(texts)] - want).max() < 1e-4
    assert (m.scores([None, "", " "]) == 0).all()


def test_terms_in_chunks_are_those_of_the_text():
    k = offence._Known()
    for t in ("Y o u, s*t*u*p*i*d i.d.i.o.t! it's 3.5% of 10,000 (a_b_c) f#ck m0r0n", "粗利益率は50%に改善し、物流費は減少。", "x" * 90 + " y", "i h a t e it"):
        want = [offence._hash(offence.word_form(w)) for w in k.word.findall(k.spaced.sub(offence._together, offence.unicodedata.normalize("NFKC", t).casefold()))]
        assert offence.terms(t).tolist() == want


def test_held_out_accuracy_on_the_test_tables(spark):
    """Fitted on half of the labels; the threshold is the best on a quarter, and must be near the one in use; figures are of the quarter that neither saw."""
    d = next(x for x in TABLES if Path(x).is_dir())
    rows = offence.labelled(table(spark, d, "documents"), table(spark, d, "content_labels")).select("text", "cats", (F.pmod(F.xxhash64("doc_id"), F.lit(4))).alias("part")).orderBy("doc_id").collect()
    of = lambda parts: ([r["text"] for r in rows if r["part"] in parts], [set(r["cats"]) for r in rows if r["part"] in parts])
    m = offence.train(*of((0, 1)))

    def measured(part, threshold):
        texts, labels = of((part,))
        got = [{c for c, s in zip(offence.CATEGORIES, row) if s >= threshold} for row in m.scores(texts)]
        hit, all_, said = (sum(len(x) for x in y) for y in ([a & b for a, b in zip(got, labels)], labels, got))
        return hit / max(1, said), hit / all_

    f1 = {t: 2 * p * r / max(1e-9, p + r) for t in (0.1, 0.2, 0.3, 0.4, 0.5) for p, r in [measured(2, t)]}
    assert f1[offence.THRESHOLD] > max(f1.values()) - 0.05
    precision, recall = measured(3, offence.THRESHOLD)
    assert precision >= 0.95 and recall >= TABLES[d]
