from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import table
from veilmark.llm import bpe_codec
from veilmark.llm.sequences import handed_back, runs

PATH = public_tokenizers.path(bpe_codec.VOCABULARY)
CODEC = bpe_codec.codec(PATH, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(text):
    packed = CODEC.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from([*"abcdeinorst AB.1'!\n\t", "é", "ß", "日", "ж", "😀", "​", "\x1c", "\x85", "\xa0"]), max_size=60) | st.text(max_size=30))
def test_encodes_as_tiktoken(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_pieces_and_small_caches(monkeypatch):
    monkeypatch.setattr(bpe_codec, "PIECE_CACHE", 3)
    monkeypatch.setattr(bpe_codec, "PAIR_CACHE", 3)
    for text in ("a" * 5000, "thing" * 2000, "<|endoftext|>", "日本" * 500, "ab ba " * 100, "abcdefghij" * 300):
        assert ids(text) == REFERENCE.encode_ordinary(text)


def test_pairs_are_compatible_as_merging_says():
    tokens = [t for t in range(0, 50_000, 997) if t in CODEC.halves]
    for a in tokens:
        for b in tokens:
            names = [CODEC.bytes_of[a], CODEC.bytes_of[b]]
            assert CODEC.compatible(a, b) == (CODEC.merged(b"".join(names)) == names)


def test_table(spark, texts):
    found = {r.doc_id: r for r in bpe_codec.encode(table(spark, texts)).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        want = REFERENCE.encode_ordinary(text or "")
        row = found[doc_id]
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_codec.report(table(spark, [])).count() == 0


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "same text", "en", "a")] * 3 + [(None, "same text", "en", "b"), (None, None, None, None)]
    n = len(REFERENCE.encode_ordinary("same text"))
    found = bpe_codec.encode(table(spark, rows), carry=("lang", "source", "digest")).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.lang, r.source, r.digest) for r in found), key=str) == sorted([(1, n, "en", "a", "d")] * 3 + [(None, n, "en", "b", "d"), (None, 0, None, None, "d")], key=str)
    assert bpe_codec.report(table(spark, rows)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_workers_keep_no_caches(spark):
    """A worker goes on to other stages; what it keeps is the vocabulary alone."""
    path, pattern = public_tokenizers.path(bpe_codec.VOCABULARY), public_tokenizers.PATTERN
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' another', id * 7) AS text")
    assert bpe_codec.encode(docs).count() == 400

    def held(batches):
        for batch in batches:
            own = bpe_codec.codec(path, pattern)
            yield pa.RecordBatch.from_arrays([pa.array([len(own.pieces) + len(own.pairs)] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(8).mapInArrow(held, "n long").collect()} == {0}


def test_runs_are_short():
    """Arrays over a run's bytes are many times its size."""
    found = list(runs(pa.array(["abc " * 1000] * 1000 + ["x" * 2_000_000])))
    assert max(len(data) for _, data, _ in found[:-1]) <= 1 << 18 and len(found[-1][1]) == 2_000_000
    assert sum(len(offsets) - 1 for _, _, offsets in found) == 1001


def test_memory_is_handed_back_once_a_task_ends():
    assert list(handed_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
