from __future__ import annotations

import random
import zlib

import numpy as np

from tests.llm.conftest import table
from veilmark.llm import language_id

WORDS = {"en": "the of and thing with house water".split(), "de": "der die und straße zwischen wörter haus".split(), "fr": "le la être où façon eau maison".split()}


def rows(n):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(4, 40))), lang))
    return out


def test_accuracy_and_folds(spark):
    own = rows(600)
    found = {r.doc_id: r for r in language_id.report(table(spark, own)).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in own)
    held = [(found[i].lang_pred, lang) for i, _, lang in own if found[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values()) and not any(r.rejected for r in found.values())


STRANGE = ["qzxv kjw qxz vvkq " * 30, "日本語のテキストです。" * 20, "Привет как дела у тебя " * 20, "lorem ipsum dolor sit amet consectetur adipiscing elit " * 10, "0x7f ff00 ab12 dead beef " * 20]


def test_what_no_language_explains_is_rejected(spark):
    """Trained on the test documents: other scripts, other languages and random letters go, the documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    other = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(STRANGE)], docs.schema)
    model = language_id.fit(docs.filter(~language_id.held_out(docs["doc_id"])))
    found = {r.doc_id: r.rejected for r in language_id.predict(docs.unionByName(other), model).collect()}
    assert all(found[10_000_000 + i] for i in range(len(STRANGE)))
    assert sum(r for i, r in found.items() if i < 10_000_000) <= 2
    held = {r.doc_id: r.lang for r in docs.filter(language_id.held_out(docs["doc_id"])).collect()}
    predicted = {r.doc_id: r.lang_pred for r in language_id.report(docs).collect()}
    assert np.mean([predicted[i] == lang for i, lang in held.items()]) > 0.98


def test_labels_of_held_out_documents_are_not_read(spark):
    own = rows(300)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in own]
    a, b = (sorted(map(tuple, language_id.report(table(spark, r)).collect())) for r in (own, other))
    assert a == b


def test_odd_texts(spark):
    own = [*rows(200), (1000, None), (1001, ""), (1002, "123 ... !!"), (1003, "the " * 50_000), (None, "der und die"), (1004, "qq" * 500), (1005, "the of and", None)]
    found = {r.doc_id: r for r in language_id.report(table(spark, own)).collect()}
    assert len(found) == len(own)
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred == "en" and found[None].lang_pred == "de" and found[None].held_out
    assert found[1004].rejected and found[1004].lang_pred in WORDS
    kept = language_id.keep(table(spark, own))
    assert kept.columns == table(spark, own).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in own} - {1000, 1001, 1002, 1004}
    assert {r.lang for r in kept.filter("doc_id = 1005").collect()} == {"en"}


def test_nothing_to_learn(spark):
    assert language_id.report(table(spark, [])).count() == 0
    found = language_id.report(table(spark, [(1, "the", None)])).collect()
    assert [(r.lang_pred, r.rejected) for r in found] == [("und", True)]
    assert [r.doc_id for r in language_id.keep(table(spark, [(1, "the", None), (2, "1 2 3", None), (3, None, None)])).collect()] == [1]


def test_centroids_by_brute_force(spark):
    """Counts, weights and cosines one n-gram and one document at a time, from the learned frequencies and centroids."""
    own = [*rows(200), (1001, "der die"), (1001, "der die"), (1002, "é"), (1003, "x")]
    docs = table(spark, own)
    train = docs.filter(~language_id.held_out(docs["doc_id"]))
    model = language_id.fit(train)

    def grams(text):
        raw = (text or "").lower().encode()
        letter = [b >= 128 or chr(b).isalpha() for b in raw]
        found = {}
        for at in range(len(raw)):
            for size in (1, 2, 3):
                if letter[at] and at + size <= len(raw):
                    value = 0
                    for k in range(size):
                        value = value << 8 | (raw[at + k] if letter[at + k] else 0)
                    where = int(language_id.mixed(np.array([value + (size << 40)], np.uint64))[0]) % language_id.DIMS
                    found[where] = found.get(where, 0) + 1
        return found

    kept = [(i, t) for i, t, *_ in own if zlib.crc32(str(i).encode()) % 5]
    often = np.zeros(language_id.DIMS)
    for _, t, *_ in kept:
        often[list(grams(t))] += 1
    assert np.allclose(model.idf, np.log((1 + len(kept)) / (1 + often)) + 0.05, atol=1e-5)
    for r in language_id.report(docs).collect():
        text = next(t for i, t, *_ in own if i == r.doc_id)
        vector = np.zeros(language_id.DIMS)
        for where, n in grams(text).items():
            vector[where] = np.log1p(n) * model.idf[where]
        cosine = model.centroids @ (vector / np.linalg.norm(vector))
        assert abs(r.score - np.clip(cosine.max(), 0, 1)) < 1e-4 and model.languages[int(cosine.argmax())] == r.lang_pred


def test_profiles_do_not_cross_texts():
    data = "ab".encode(), "cd é".encode(), b"", b"abcd"
    joined = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    alone = [language_id.profiles(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data]
    assert (language_id.profiles(joined, offsets) == np.stack(alone)).all()


def test_sample_is_bounded(spark):
    model = language_id.fit(table(spark, rows(400)), sample_per_language=20, centroids=3)
    assert len(model.centroids) <= 9 and model.centroids.shape[1] == language_id.DIMS
