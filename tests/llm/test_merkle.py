from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veilmark.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, path string, part int, at long, up string, `index` long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out.append((i - first, level[first : first + 16]))
        i //= 16
    return out


def brute(rows):
    leaf = lambda r, text: h(*(field(v) for v in (*r[:4], text)))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = way(trees[s], i) + way(top, k)
            acc = leaf(r, lowered(r[4]) if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 0 else r[4])
            for place, run in steps:
                acc = h(*run[:place], acc, *run[place + 1 :])
            proof = h(*(d for place, run in steps for j, d in enumerate(run) if j != place))
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "t", "d", "p", 7, 1, "u", 3) for r in rows], SCHEMA)


def found(spark, rows):
    return sorted(map(tuple, merkle_manifest.report(made(spark, rows)).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_one_source(spark, n):
    rows = [(i * 3, "s", None, i, f"Text {i}") for i in range(n)]
    assert found(spark, rows) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    """Null sources, ids and texts, repeated rows and ids, an empty source, other alphabets, a hot source and many small ones."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 6 + ["é", "日", "a", "B", "", None]), rnd.choice(["en", None]), rnd.choice([1, None]), rnd.choice([None, "", "ABC é", "x" * 200_000, f"Word {i}"])) for i in range(700)]
    rows += [(5, "hot", "en", 1, "same"), (5, "hot", "en", 1, "same"), (5, "hot", "en", 1, "other"), (None, "hot", None, None, None), (None, None, None, None, "A")]
    rows += [(10_000 + i, f"s{i:03}", "en", 1, "Alone") for i in range(40)]
    rnd.shuffle(rows)
    assert found(spark, rows) == sorted(brute(rows), key=repr)


def test_many_ranges(spark):
    """Runs that no single range has whole are completed by adding forests, over more than one round."""
    rows = [(i, "s" if i % 9 else f"t{i % 5}", "en", i, f"T{i}") for i in range(900)]
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == sorted(brute(rows), key=repr)
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_forests_add_up_in_any_order():
    """The monoid: however leaves are dealt and added, the same runs and roots come of it."""
    leaves = [("a", 40, 0, i, h(str(i)).encode()[:32]) for i in range(40)] + [("b", 1, 0, 0, b"x" * 32), ("c", 17, 0, 16, b"y" * 32)] + [("c", 17, 0, i, b"z" * 32) for i in range(16)]
    results = []
    for seed in range(4):
        rnd = random.Random(seed)
        dealt = [[] for _ in range(5)]
        for leaf in leaves:
            rnd.choice(dealt).append(leaf)
        done, forests = [], []
        for part in dealt:
            forest = merkle_manifest.Forest(lambda *row: done.append(row[:6]))
            for leaf in part:
                forest.add(*leaf)
            forests.append(forest)
        while len(forests) > 1:
            a = forests.pop(rnd.randrange(len(forests)))
            b = forests.pop(rnd.randrange(len(forests)))
            for _, tree, size, level, index, digest, _ in list(a.rows()):
                b.add(tree, size, level, index, digest)
            forests.append(b)
        assert not forests[0].open
        results.append(sorted(done, key=repr))
    assert all(r == results[0] for r in results) and sum(r[0] == "root" for r in results[0]) == 3


def test_empty_table(spark):
    made_ = merkle_manifest.report(made(spark, []))
    assert made_.collect() == [] and made_.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_finds_what_was_changed(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"Text {i}") for i in range(100)]
    docs = made(spark, rows)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 42, "other").otherwise(F.col("text")))
    whole = merkle_manifest.manifest(docs, also={"now": merkle_manifest.leaf(docs, instead={"text": F.when(docs["doc_id"] == 42, "other").otherwise(docs["text"])})})
    assert [r.id for r in merkle_manifest.verified(whole, "now").filter("not verified").collect()] == [42]
    assert merkle_manifest.manifest(changed).root != whole.root == merkle_manifest.manifest(docs.repartition(7)).root
