from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import table
from veilmark.llm import fingerprint_index, repeats, sequences, suffix_dedup


def covered(units, least, seen):
    mark = [False] * len(units)
    for s in range(len(units) - least + 1):
        window = bytes(units[s : s + least]) if isinstance(units, bytes) else tuple(units[s : s + least])
        if window in seen:
            mark[s : s + least] = [True] * least
        else:
            seen.add(window)
    return mark


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_bytes(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        mark = covered(data, 100, seen)
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((doc_id, len(data), sum(mark), spans, sha(bytes(b for b, m in zip(data, mark) if not m))))
    return sorted(out, key=repr)


def brute_words(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        mark = covered(words, 20, seen)
        out.append((doc_id, len(words), sum(mark), sha(b" ".join(w for w, m in zip(words, mark) if not m))))
    return sorted(out, key=repr)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
def test_bytes(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats.contents, "__defaults__", (hot,))
    assert got(suffix_dedup.deduplicate(table(spark, texts))) == brute_bytes(ordered(texts))


@pytest.mark.parametrize("null", [False, True])
def test_bytes_shuffle_texts_once(spark, texts, null):
    found = suffix_dedup.deduplicate(table(spark, [*texts, (None, "x " * 200)] if null else texts))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("ReusedExchange" in line and "text#" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize(("hot", "batches", "fanout"), [(1000, 2, 4), (2, 5, 2), (1000, 1, 1)])
def test_words(spark, texts, monkeypatch, hot, batches, fanout):
    monkeypatch.setattr(repeats.contents, "__defaults__", (hot,))
    assert got(fingerprint_index.deduplicate(table(spark, texts), batches=batches, fanout=fanout)) == brute_words(ordered(texts))


def test_index_opens_again(spark, texts, tmp_path):
    """Batches in any order of ids, each by another opening of the index's folder; what was added before counts as earlier."""
    rows = [(i, t) for i, t in texts if t]
    batches = [rows[60:], rows[:30], rows[30:60]]
    found, earlier, order = {}, None, []
    for number, own in enumerate(batches):
        docs = spark.createDataFrame(own, "uid long, text string")
        index = fingerprint_index.FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=1)
        assert len(index.runs) == min(number, 1)
        for r in index.add(docs, earlier).collect():
            found.setdefault(r.uid, set()).update(range(r.start, r.start + r.size))
        for run in index.runs:  # as a new session, which knows no tables
            spark.sql(f"DROP TABLE {run}")
        earlier = docs if earlier is None else earlier.unionByName(docs)
        order += sorted(own)
    assert {i: len(found.get(i, ())) for i, _ in rows} == {r[0]: r[2] for r in brute_words(order)}
    fingerprint_index.FingerprintIndex(spark, f"file://{tmp_path}/index").drop()
    assert not (tmp_path / "index").exists()


def shuffled(spark, run):
    """Bytes that shuffles wrote while run() ran."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def count():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = count()
    run()
    return count() - before


def test_history_is_not_shuffled(spark):
    """What ten new documents cost in shuffles does not grow with what was added before."""
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
    cost = []
    for n in (200, 2000):
        old = [(i, text()) for i in range(n)]
        new = [(10_000 + i, text() if i % 2 else old[i][1]) for i in range(10)]
        earlier, batch = (spark.createDataFrame(rows, "uid long, text string") for rows in (old, new))
        index = fingerprint_index.FingerprintIndex(spark)
        index.add(earlier).collect()
        found = []
        cost.append(shuffled(spark, lambda: found.extend(index.add(batch, earlier).collect())))  # noqa: B023
        assert {r.uid for r in found} == {10_000 + i for i in range(0, 10, 2)}
        index.drop()
    assert cost[1] < 1.5 * cost[0] + 100_000


@pytest.mark.parametrize("step", ["create", "rename", "delete"])
def test_a_crash_leaves_an_index(spark, tmp_path, monkeypatch, step):
    """Wherever saving stops, the folder opens as the index before or after, never as an empty one."""
    words = lambda i: " ".join(f"w{i}-{k}" for k in range(40))
    made = lambda ids: spark.createDataFrame([(i, words(i % 3)) for i in ids], "uid long, text string")
    folder = f"file://{tmp_path}/index"
    index = fingerprint_index.FingerprintIndex(spark, folder)
    index.add(made([0, 1])).collect()
    runs = list(index.runs)
    real = fingerprint_index.FingerprintIndex._path

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise RuntimeError("lost")
            return getattr(self.fs, name)

    monkeypatch.setattr(fingerprint_index.FingerprintIndex, "_path", lambda self, name: (real(self, name)[0], Broken(real(self, name)[1])))
    index.runs = [*runs, "veilmark_run_other"]
    with pytest.raises(RuntimeError):
        index._save()
    monkeypatch.undo()
    opened = fingerprint_index.FingerprintIndex(spark, folder)
    assert opened.runs in (runs, [*runs, "veilmark_run_other"]) and (step == "delete" or opened.runs == runs)
    opened.runs = runs
    opened._save()
    again = fingerprint_index.FingerprintIndex(spark, folder)
    assert again.runs == runs and {r.uid for r in again.add(made([3, 4, 5]), made([0, 1])).collect()} == {3, 4}
    again.drop()


@pytest.mark.parametrize("make", [lambda t: [(None, t), (None, t), (3, t), (3, t), (1, "x"), (None, None)], lambda t: []])
def test_repeated_and_missing_ids(spark, make):
    rows = make(" ".join(map(str, range(200))))
    assert got(suffix_dedup.deduplicate(table(spark, rows))) == brute_bytes(ordered(rows))
    assert got(fingerprint_index.deduplicate(table(spark, rows))) == brute_words(ordered(rows))


def thue_morse(n, first="a", second="b"):
    return "".join((first, second)[i.bit_count() & 1] for i in range(n))


def test_words_that_fool_polynomials(spark):
    """A Thue-Morse word and its complement have one hash modulo a power of two, whatever the base."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*words[:10], thue_morse(2048), *words[10:20]])), (2, " ".join([*words[:10], thue_morse(2048, "b", "a"), *words[10:20]])), (3, thue_morse(4096)), (4, thue_morse(4096, "b", "a")), (5, "x" + thue_morse(4096))]
    assert got(fingerprint_index.deduplicate(table(spark, rows))) == brute_words(rows)
    assert got(suffix_dedup.deduplicate(table(spark, rows))) == brute_bytes(rows)


def test_groups(spark, texts):
    """Every group's occurrences hold its string, and all but the earliest of each are what goes."""
    rows = [(i, t) for i, t in texts if i < 80]
    data = {i: (t or "").encode() for i, t in rows}
    groups: dict[int, list] = {}
    for r in suffix_dedup.groups(table(spark, rows)).collect():
        groups.setdefault(r.group, []).append((r.doc_id, r.start, r.length))
    mark = {i: [False] * len(d) for i, d in data.items()}
    assert groups
    for at in groups.values():
        at.sort()
        assert len(at) > 1 and len({data[i][s : s + n] for i, s, n in at}) == 1 and min(n for *_, n in at) >= 100
        for i, s, n in at[1:]:
            mark[i][s : s + n] = [True] * n
    assert {i: sum(m) for i, m in mark.items()} == {r[0]: r[2] for r in brute_bytes(ordered(rows))}


def test_left_extension_decides(texts, monkeypatch):
    """Only intervals that can't be extended to the left are groups; without them nothing would go."""
    strings = [t.encode() for i, t in texts if i < 80 and t and len(t) > 100]
    alone = suffix_dedup.maximal_repeats(strings, 100)
    every = [x for x in suffix_dedup.intervals(*(lambda a: (a.common, a.before))(suffix_dedup.SuffixArray([s for s in strings if len(s) >= 100], [len(s) - 99 for s in strings if len(s) >= 100])), 100)]
    assert 0 < len(alone) < len(every)
    rows = [(0, i, 0, max(0, len(s) - 99), s) for i, s in enumerate(strings) if len(s) >= 100]
    assert list(suffix_dedup._resolve(rows, 100))
    honest = suffix_dedup.intervals
    monkeypatch.setattr(suffix_dedup, "intervals", lambda *a: ((n, low, high, False) for n, low, high, _ in honest(*a)))
    assert not list(suffix_dedup._resolve(rows, 100))


def test_small_flushes_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "COMBINE_SEGMENTS", 50)
    monkeypatch.setattr(sequences, "RUN_BYTES", 300)
    assert got(suffix_dedup.deduplicate(table(spark, texts).repartition(7))) == brute_bytes(ordered(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=25), min_size=1, max_size=4))
def test_maximal_repeats(strings):
    """All right- and left-maximal repeats of three bytes or more, with all occurrences."""
    raw = [s.encode() for s in strings]
    places: dict[bytes, list[tuple[int, int]]] = {}
    for i, s in enumerate(raw):
        for a in range(len(s)):
            for b in range(a + 3, len(s) + 1):
                places.setdefault(s[a:b], []).append((i, a))
    want = set()
    for piece, at in places.items():
        before = {raw[i][a - 1] if a else (i, -1) for i, a in at}
        after = {raw[i][a + len(piece)] if a + len(piece) < len(raw[i]) else (i, -1) for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want.add((len(piece), tuple(at)))
    assert {(n, tuple(at)) for n, at in suffix_dedup.maximal_repeats(raw, 3)} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5))
def test_segments_hold_every_window_once(lists):
    values = np.array([x for own in lists for x in own], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    offsets = np.cumsum([0, *map(len, lists)])
    found = sequences.segments(values, offsets, 6, 3, values.tobytes(), 8)
    found["count"] = repeats.counts(found["tail"])
    windows = sorted((t, s + i) for t, s, n in zip(found["text"], found["start"], found["count"]) for i in range(n))
    assert windows == [(t, s) for t, own in enumerate(lists) for s in range(len(own) - 5)]
    anchors: dict[tuple, set] = {}
    for t, s, n, a in zip(found["text"], found["start"], found["count"], found["anchor"]):
        for i in range(n):
            anchors.setdefault(tuple(lists[t][s + i : s + i + 6]), set()).add(int(a))
    assert all(len(a) == 1 for a in anchors.values())


def test_words_and_their_hashes():
    """Words as bytes.split() gives them; equal hashes for equal words only, whatever stands around them."""
    rnd = np.random.default_rng(4)
    letters = ["a", "B", " ", "\n", "\t", "\x0b", "\x0c", "\r", "é", " ", "\x1c", "\x85", "日", "ab" * 40]
    known: dict[bytes, tuple[int, int]] = {}
    for _ in range(200):
        texts = ["".join(letters[i] for i in rnd.integers(0, len(letters), rnd.integers(0, 14))) for _ in range(5)]
        for lower in (False, True):
            for _, data, offsets in sequences.runs(pa.array(texts)):
                made = sequences.Words(data, offsets, lower)
                want = [(t.encode().lower() if lower else t.encode()).split() for t in texts]
                assert np.diff(made.offsets).tolist() == list(map(len, want))
                for word, pair in zip((w for own in want for w in own), zip(made.hash.tolist(), made.other.tolist())):
                    assert known.setdefault(word, pair) == pair
    assert len({a for a, _ in known.values()}) == len({b for _, b in known.values()}) == len(known) > 200


def test_merged_intervals():
    doc, start, end = repeats.merged(np.array([2, 1, 1, 1, 2]), np.array([5, 0, 3, 9, 0]), np.array([8, 3, 4, 12, 5]))
    assert list(zip(doc, start, end)) == [(1, 0, 4), (1, 9, 12), (2, 0, 8)]
