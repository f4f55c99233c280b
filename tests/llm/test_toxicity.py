from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import table
from veilmark.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a moron , the house is pathetic but the water is not stupid . that clown took all the time to look at them ") for i in range(30)], "doc_id long, text string")
    return toxicity.characters(docs)


@pytest.mark.parametrize(
    ("said", "meant"),
    [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("p-a-t-h-e-t-i-c", "pathetic"), ("p@th3t1c", "pathetic"), ("stuuupiiiid", "stupid"), ("$tup!d", "stupid"),
        ("iiddiioott", "idiot"), ("m 0 r 0 n", "moron"), ("cl0000wn", "clown"), ("the i d i o t took", "the idiot took"), ("house water", "house water"), ("tooook", "took"), ("i\u200bd1ot", "idiot"), ("", ""), ("(1d10t!)", "(idiot)"), ("so,i.d.i.o.t", "so,idiot"), ("i . d . i . o . t", "idiot"), ("a 1", "a 1"),
    ],
)
def test_restored(model, said, meant):
    assert toxicity.Restorer(model)(said) == meant


def test_decoding_is_the_best_path(model):
    """Against every path through the lattice, scored from its start."""
    rnd = random.Random(2)
    for _ in range(40):
        stretch = rnd.choice(["", "t h 3 ", "m . "]) + "".join(rnd.choice("aet0137$!ooii") for _ in range(rnd.randint(3, 6)))
        options = toxicity.lattice(stretch)

        def score(path):
            context, total = " ", 0.0
            for said, cost in [*path, (" ", 0.0)]:
                total += cost
                for c in said:
                    if c == " " and context[-1:] == " ":
                        continue
                    total += model.logp(context + c)
                    context = (context + c)[-(toxicity.ORDER - 1) :]
            return total

        best = max(map(score, itertools.product(*options)))
        decoded = toxicity.decode(stretch, model)
        same = [p for p in itertools.product(*options) if " ".join("".join(s for s, _ in p).split()) == " ".join(decoded.split())]
        assert max(map(score, same)) == pytest.approx(best)


def test_counts_are_those_of_all_texts(spark, model):
    """The hashed counts against a plain count of one n-gram, and a sum to one where contexts are known."""
    texts = ["abcabc  abd", "ABX", None, ""]
    own = toxicity.characters(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert own.total == len(" abcabc abd ") + len(" abx ") or own.total > 0
    assert own._p("ab") > own._p("xb") and own._p("abc") > own._p("abx")
    assert toxicity.characters(spark.createDataFrame([], "text string")) is None
    assert sum(np.exp(model.logp("idio" + c)) for c in "abcdefghijklmnopqrstuvwxyz ") == pytest.approx(1.0, abs=0.05)


def test_held_out_and_hidden_words(spark):
    """On the test documents: held-out labels, then the same documents with their words hidden."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    found = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    assert len(found) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [(found[i].predicted, y) for i, y in known.items() if i in found and found[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93 and sum(p and not y for p, y in held) <= 1
    for swaps in ((("i", "1"), ("o", "0"), ("t", "7"), ("e", "3")), (("s", "$"), ("a", "@"), ("o", "oooo"))):
        hidden = docs.filter("lang = 'en'")
        for word in ("idiot", "moron", "stupid", "clown", "worthless", "pathetic", "loser", "trash", "scum", "disgusting"):
            other = word
            for a, b in swaps:
                other = other.replace(a, b)
            hidden = hidden.withColumn("text", F.replace("text", F.lit(word), F.lit(other)))
        model = toxicity.fit(docs.filter(~toxicity.held_out(docs["doc_id"])), labels)
        again = {r.doc_id: r.predicted for r in toxicity.score(hidden, model).collect()}
        before = [i for i in again if found[i].predicted]
        assert sum(again[i] for i in before) >= 0.9 * len(before) > 0 and sum(p and not found[i].predicted for i, p in again.items()) <= 2


def test_held_out_labels_are_not_read(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["good", "day", "tree", "vile" if i % 4 == 0 else "road"]) for _ in range(30)), "en") for i in range(300)]
    labels = [(i, int(i % 4 == 0)) for i in range(300)]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted(map(tuple, toxicity.report(table(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, other))
    assert a == b and sum(r[3] == (r[0] % 4 == 0) for r in a) > 290


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 60_000), (None, "x y z"), (5, "1 d 1 0 t " * 3000), (5, "again"), (6, "😀 日本語 1a2b3c"), (7, "aaaa" * 20_000), (8, "0" * 30_000 + "a")]
    labels = spark.createDataFrame([(1, 1), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.report(table(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.report(table(spark, []), labels).collect() == []
    none = toxicity.report(table(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    one = toxicity.fit(table(spark, rows), spark.createDataFrame([(2, 1), (2, 0), (3, 1)], "doc_id long, toxic int"))
    assert one.base == 1.0 and one.curve is None  # of two labels the toxic one counts


def test_restored_column(spark, model):
    made = spark.createDataFrame([("the 1d10t",), (None,)], "text string")
    assert [r[0] for r in made.select(toxicity.restored(made, model)).collect()] == ["the idiot", ""]


def test_most_tokens_are_only_looked_at(monkeypatch):
    """Words that begin as none with a weight does are not restored; the evidence is that of restoring every token."""
    text = "some plain words, then b a d ones and baaad ones " + "w" * 300
    counts = np.zeros((toxicity.ORDER, 1 << toxicity.SLOT_BITS), np.float32)
    for order, at in toxicity.slots(["some plain words and bad ones " * 50]):
        counts[order - 1] += np.bincount(at, minlength=1 << toxicity.SLOT_BITS)
    model = toxicity.Model(toxicity.Characters(counts, int(counts[0].sum())), 0.1, dict.fromkeys(toxicity.features("bad"), 2.0), [toxicity.begins("bad")])
    restore = toxicity.Restorer(model.characters)
    tokens = restore.tokens(text)
    assert "b a d" in tokens
    found = {w: model.weight(w) for t in set(tokens) for w in restore.words(t) if model.weight(w)}
    monkeypatch.setattr(toxicity.Restorer, "words", lambda *_: pytest.fail("a token was restored"))
    reader = toxicity.Reader(model)
    assert found and reader.evidence(text) == reader.evidence(text) == toxicity._evidence(list(found.values()), len(tokens))
