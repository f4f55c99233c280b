from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import table
from veilmark.llm import components, jaccard_join, pivot_index

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in reached(sets, links).items()}


def reached(nodes, links):
    least = {n: n for n in nodes}
    while True:
        new = dict(least)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            return least
        least = new


def many(n, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 4)) for _ in range(40)] for _ in range(5)]
    out = []
    for i in range(n):
        words = rnd.choice(base)[: rnd.choice([1, 3, 4, 6, 20, 40])]
        for _ in range(rnd.randint(0, 3)):
            words = [*words]
            words[rnd.randrange(len(words))] = rnd.choice("xyzXYZ")
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize(("width", "percent", "share", "block", "crowd"), [(5, 80, 0.002, 512, 64), (4, 85, 0.1, 128, 3), (2, 80, 0.05, 7, 64), (2, 60, 0.2, 3, 4), (1, 50, 0.1, 5, 2)])
def test_groups(spark, monkeypatch, width, percent, share, block, crowd):
    monkeypatch.setattr(jaccard_join, "FREQUENT_SHARE", share)
    rows = many(250, width)
    found = jaccard_join.link(table(spark, rows), width=width, percent=percent, block=block, crowd=crowd)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, width, percent)


def overlapping(n):
    """Documents of one template with as many changes as leave some similar and others not: they share many signatures."""
    rnd = random.Random(n)
    base = [f"w{k}" for k in range(40)]
    return [(i, " ".join(rnd.choice("xyz") + str(i) if k in drop else w for k, w in enumerate(base))) for i in range(n) for drop in [rnd.sample(range(40), rnd.randint(1, 4))]]


@pytest.mark.parametrize("unite", [2, 20])
def test_united_groups(spark, monkeypatch, unite):
    monkeypatch.setattr(jaccard_join, "UNITE", unite)
    monkeypatch.setattr(jaccard_join, "FREQUENT_SHARE", 0.05)
    rows = many(150, 3) + [(1000 + i, t) for i, t in overlapping(150)]
    found = jaccard_join.link(table(spark, rows), width=2, percent=80, block=16, crowd=8)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 2, 80)


def test_overlapping_groups_are_compared_once(spark, monkeypatch):
    block, n, made = 64, 300, []
    between = jaccard_join.between_blocks

    def counted(*args):
        tasks = between(*args)
        made.append(tasks.count())
        return tasks

    monkeypatch.setattr(jaccard_join, "between_blocks", counted)
    rows = overlapping(n)
    found = jaccard_join.link(table(spark, rows), width=4, percent=70, block=block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 4, 70)
    assert 0 < made[0] <= 2 * n * (n // block + 2)  # once for each other block, not for each shared signature


def test_pipeline_compares_overlapping_groups_once(spark, monkeypatch):
    n, made = 1300, []
    between = jaccard_join.between_blocks

    def counted(*args):
        tasks = between(*args)
        made.append(tasks.count())
        return tasks

    monkeypatch.setattr(jaccard_join, "between_blocks", counted)
    rnd, rows = random.Random(9), []
    for i in range(n):
        words = [f"w{k}" for k in range(120)]
        for k in rnd.sample(range(120), rnd.randint(1, 4)):
            words[k] = rnd.choice("xyz") + str(i)
        rows.append((i, " ".join(words)))
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "test_similar")
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
    assert 0 < made[0] <= 2 * n * (n // jaccard_join.BLOCK + 2)


def test_signatures_never_miss():
    rnd = random.Random(2)
    for _ in range(3000):
        percent, combine = rnd.choice([50, 60, 80, 85]), jaccard_join.COMBINE_SIZE
        universe = np.sort(np.array(rnd.sample(range(1, 10_000), 60), np.uint64))
        frequent = np.sort(np.array(rnd.sample(list(map(int, universe)), rnd.choice([0, 10, 30, 60])), np.uint64))
        a = set(rnd.sample(list(map(int, universe)), rnd.randint(1, 40)))
        b = set(a)
        for _ in range(rnd.randint(0, 6)):
            (b.discard if rnd.random() < 0.5 else b.add)(int(rnd.choice(list(universe))))
        if not b or 100 * len(a & b) < percent * len(a | b):
            continue
        jaccard_join.COMBINE_SIZE = rnd.choice([5, 20, 400])
        try:
            x, y = (jaccard_join.signatures(np.array(sorted(s), np.uint64), frequent, percent) for s in (a, b))
        finally:
            jaccard_join.COMBINE_SIZE = combine
        assert set(map(int, x)) & set(map(int, y)), (sorted(a), sorted(b), percent)


def test_mixed_documents(spark, texts):
    found = jaccard_join.link(table(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(texts, 5, 80)


def test_words_that_fool_polynomials(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "p q r s " + word), (4, "p q r s " + word.translate(str.maketrans("ab", "ba"))), (5, word)]
    found = jaccard_join.link(table(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 5, 80)


def test_exact_sets_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(jaccard_join, "mixed", lambda x: x & np.uint64(1))
    monkeypatch.setattr(jaccard_join.Rolling, "grams", lambda self, k: np.zeros(len(self.sums) - k, np.uint64))
    numbers = jaccard_join.Numbers()
    a, b = (jaccard_join.ExactSet(t, 2, numbers) for t in (b"a b c d e", b"b c d x"))
    assert (len(a), len(b), a.common(b)) == (4, 3, 2)


def test_bitmaps_never_part_what_is_similar():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        a = rnd.integers(0, 2**63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(rnd.integers(0, 1 + n // 4)) :], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 4)), dtype=np.uint64)]))
        a = np.unique(a)
        if not len(b):
            continue
        common = len(np.intersect1d(a, b))
        percent = 80
        x, _, _ = jaccard_join.near_pairs(np.zeros(2, int), np.array([len(a), len(b)]), np.array([1, 2]), np.array([2, 2]), [jaccard_join.bitmap(s) for s in (a, b)], percent)
        assert len(x) or common * 100 < percent * (len(a) + len(b) - common)


def test_keep(spark):
    text = " ".join(map(str, range(50)))
    docs = table(spark, [(3, text), (1, text + " x"), (2, "other words here"), (4, None), (None, text)])
    kept = jaccard_join.keep(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4]
    assert jaccard_join.keep(table(spark, [])).count() == 0


def test_keep_decides_by_row(spark):
    """Near copies go alone, not with every row that shares their id or has none."""
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(None, a), (None, "no copy of anything at all"), (1, a + " x"), (5, b), (5, b + " y"), (5, "unrelated to the other rows of five"), (7, None), (None, None)]
    docs = table(spark, rows)
    kept = jaccard_join.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((rows[i] for i in (1, 2, 3, 5, 6, 7)), key=str)


@pytest.mark.parametrize("few", [components.FEW_LINKS, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    want = {n: c for n, c in reached({x for p in links for x in p}, links).items()}
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: want[n] for n in linked}


def test_vectors(spark):
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(40, 16))
    vectors = [centres[i % 40] + rnd.normal(size=16) * rnd.choice([0.05, 0.2, 0.4]) for i in range(600)]
    vectors += [vectors[0]] * 5 + [v * 3 for v in vectors[:10]]
    rows = [(i, [float(x) for x in v], 7) for i, v in enumerate(vectors)]
    unit = np.stack(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    want = reached(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(close)) if a < b])
    found = {r.vec_id: r for r in pivot_index.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    links = sum(r.n_links for r in found.values())
    assert close.sum() > 1000 and 0.99 * close.sum() <= links <= close.sum()
    assert all(found[i].n_links <= close[i].sum() for i in found)
    assert np.mean([found[i].component_id == want[i] for i in found]) > 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_shared_counts():
    rnd = np.random.default_rng(1)
    left, right = (np.stack([rnd.permutation(20)[:5] for _ in range(n)]) for n in (30, 40))
    count, owned = pivot_index.shared_counts(left, right, 7)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            common = set(a) & set(b)
            assert count[i, j] == len(common) and owned[i, j] == any(p < 7 for p in common)


def test_described_by_distance():
    rnd = np.random.default_rng(2)
    unit, pivots = rnd.normal(size=(50, 6)), rnd.normal(size=(64, 6))
    pivots[40:] = pivots[:24]  # ties
    want = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :8]
    assert np.allclose(np.take_along_axis(unit @ pivots.T, pivot_index.described(unit, pivots, 8), 1), np.take_along_axis(unit @ pivots.T, want, 1))


def test_blocks_are_bounded_at_any_size():
    for n in (10**4, 10**6, 10**9, 10**12):
        for width in (8 * 16, 8 * 64, 8 * 4096):
            pivots = min(max(16, round(1.2 * n**0.5)), pivot_index.PIVOT_BYTES // width)
            assert pivot_index.block_rows(n * pivot_index.NEAREST / pivots, width) * (width + 64) <= pivot_index.BLOCK_BYTES


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.1]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [float("inf"), 1.0]), (11, [-1.0, 0.0])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_index.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 7: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 8, 9, 10, 11)}
    assert pivot_index.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    same = pivot_index.link(spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in same.collect()) == [("4", 2, 4), ("4", 2, 4), ("None", 2, 4)]


def clustered(n, seed=3, size=64, cosine=0.93):
    """n vectors, a third of them around one centre with this cosine between any two."""
    rnd = np.random.default_rng(seed)
    rows = rnd.normal(size=(n, size))
    centre = rnd.normal(size=size)
    rows[: n // 3] = centre / np.linalg.norm(centre) + rnd.normal(size=(n // 3, size)) * np.sqrt((1 / cosine - 1) / size)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_dense_cluster(spark, n):
    unit = clustered(n)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(unit.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in pivot_index.link(rows).collect()}
    assert all(found[i] <= links[i] for i in found) and sum(found.values()) >= 0.99 * links.sum()


@pytest.mark.parametrize("cosine", [0.89, 0.93, 0.97])
@pytest.mark.parametrize(("n", "n_pivots"), [(2_000, 64), (20_000, 128), (100_000, 512)])
def test_dense_cluster_shares_pivots(n, n_pivots, cosine):
    unit = clustered(n, cosine=cosine)
    drawn = np.random.default_rng(7).choice(n, n_pivots, replace=False)
    pivots = pivot_index._unit(pivot_index.apart([unit[i].tobytes() for i in drawn], pivot_index.COSINE))
    near = np.argsort(-(unit[: n // 3] @ pivots.T), axis=1, kind="stable")[:, : pivot_index.NEAREST]
    listed = np.zeros((n // 3, len(pivots)), np.float32)
    np.put_along_axis(listed, near, 1, axis=1)
    close = unit[:100] @ unit[: n // 3].T >= pivot_index.COSINE
    close[range(100), range(100)] = False
    assert (close & (listed[:100] @ listed.T >= pivot_index.MIN_SHARED)).sum() >= 0.95 * close.sum()


@pytest.mark.parametrize("n_pivots", [64, 1024, 8192])
def test_near_vectors_share_pivots_among_many(n_pivots):
    """Pairs just above the limit become candidates, however many pivots there are."""
    rnd = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots, one, other = unit(rnd.standard_normal((n_pivots, 64))), unit(rnd.standard_normal((400, 64))), rnd.standard_normal((400, 64))
    other = unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    two = 0.903 * one + np.sqrt(1 - 0.903**2) * other
    k = pivot_index.lists(n_pivots)
    a, b = pivot_index.described(one, pivots, k), pivot_index.described(two, pivots, k)
    found = [x[0] == y[0] or len(np.intersect1d(x, y)) >= pivot_index.MIN_SHARED for x, y in zip(a, b)]
    assert np.mean(found) > 0.98 and pivot_index.lists(512) == 8 and pivot_index.lists(131_072) == 16
