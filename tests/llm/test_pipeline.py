from __future__ import annotations

import glob
import os
import struct
from collections import Counter
from hashlib import sha256

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.conftest import table
from tests.llm.test_native import filled
from tests.llm.test_similar import reached, shingles
from veilmark.llm import bpe_codec, mixture, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    made = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(made.columns) == sorted(columns)
    key = sorted(columns)
    assert sorted(repr([r[c] for c in key]) for r in made.collect()) == sorted(repr([dict(zip(columns, r))[c] for c in key]) for r in found.fetchall())


def brute_near(rows):
    """doc_ids that stay: the smallest of each group of similar documents."""
    sets = {r.doc_id: shingles(r.text, 5) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i for i, c in reached(sets, links).items() if i == c}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        made.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    given, spoken, distinct, apart, mixed, encoded = made

    texts = {r.doc_id: r.text for r in given}
    assert {r.doc_id for r in spoken} <= set(texts) and len(spoken) >= 0.98 * len(given)
    assert sum(r.lang == g.lang for r in spoken for g in given if r.doc_id == g.doc_id) >= 0.95 * len(spoken)
    last = {}
    for r in spoken:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in distinct} == set(last.values())
    assert {r.doc_id for r in apart} == brute_near(distinct)

    size = Counter()
    for r in apart:
        size[r.source] += len(r.text.split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    want, taken, times = filled(size, weight, 1.5 * sum(size.values())), Counter(), Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
        assert r.n_chars == len(r.text)
        assert texts[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert max(times.values()) <= 2 and all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 * mixture.BLOCK_WORDS for s in size)

    ranks = bpe_codec.read_ranks(public_tokenizers.path(bpe_codec.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(r.doc_id, own.encode_ordinary(r.text), r.text) for r in mixed]
    assert sorted(tuple(r)[:5] for r in encoded) == sorted((i, len(x), sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), sha256(t.encode()).hexdigest(), x) for i, x, t in ids)
    spoken_of = {r.doc_id: (r.lang, r.source) for r in mixed}
    assert all((r.lang, r.source) == spoken_of[r.doc_id] for r in encoded)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, encoded))


ODD = {
    "empty": [],
    "nulls": [(1, None, None, None), (None, None, None, None), (2, "some words of a text", None, None)],
    "repeated": [(1, "one text with several words in it", "en", "a")] * 3 + [(1, "another text of the same id", "en", "b"), (None, "a text without an id", "en", None), (None, "a text without an id", "en", None)],
    "odd texts": [(1, "", "en", "a"), (2, " \n\t", "en", "a"), (3, "word " * 50_000, "en", "a"), (4, "w" * 300_000, "fr", "b"), (5, "12 34 !?", "fr", "b"), (6, "one two three four five six", "fr", "b")],
}


@pytest.mark.parametrize("rows", ODD.values(), ids=ODD)
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nothing crashes, columns stay, and what comes out was there before; clashing extra columns are carried."""
    docs = table(spark, rows)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k in (1, 2):
            assert not Counter(map(repr, after)) - Counter(map(repr, before)) and len({r.text for r in after}) == len(after) or k == 2
        if k == 0:
            assert {(r.doc_id, r.text) for r in after} == {(r.doc_id, r.text) for r in before if r.text and any(map(str.isalpha, r.text))} or not any(r.lang for r in before)
        if k == 4:
            assert len(after) == len(before)


def test_two_pipelines_in_one_driver(spark, tmp_path):
    """A stage frees only what its own pipeline staged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.mix_sources(spark, docs, "one")
    two = corpus_pipeline.mix_sources(spark, docs, "two")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
