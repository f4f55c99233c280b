from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from veilmark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, part string, words long, parent string, turns string"


def brute(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    said = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in said.items():
        n = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = said.get(c - c % 20, [])[:n] + v[n:]
    return rebuilt, nodes(rebuilt)


def nodes(rebuilt):
    members: dict = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids: dict = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = (len(members[k]) - 1) * words(k) + sum(saved[x] for x in kids.get(k, []))
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if len(rebuilt[c]) == len(k))))
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()),
        key=repr,
    )


def found(spark, rows):
    made = spark.createDataFrame([(*r, "k", "p", 1, "q", "t") for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.report(made).collect()), key=repr)


def talk(seed, conversations, longest=7, say=4):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice([None, "", " a  b\tc ", *(f"w{i} x" for i in range(say))])) for c in range(conversations) for t in range(rnd.randint(1, longest))]
    rnd.shuffle(rows)
    return rows


def test_small(spark):
    rows = talk(1, 120)
    assert found(spark, rows) == brute(rows)[1]


def test_odd_rows(spark):
    gone = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4)
    rows = [(3, 0, "u", "a"), (3, 0, "u", "b"), (3, None, "u", "first"), (3, 2, "u", "x"), (None, 0, "u", "no conversation"), (41, 5, "u", "word " * 50_000), (40, 1, None, None), (gone, 0, "u", "gone"), (3, 2, "u", "x"), (97, 0, "é", "日本 語")]
    rebuilt, want = brute(rows)
    assert found(spark, rows) == want and any(not v for v in rebuilt.values())  # some keep no turn at all
    assert found(spark, []) == []


@pytest.mark.parametrize(("parts", "piece"), [(40, 3), (150, 2)])
def test_stacks_are_stitched(spark, monkeypatch, parts, piece):
    """Nearly every range ends inside a group of equal conversations, or under a shared first turn; two rounds where there are many."""
    rows = [(c, t, "u", "same" if t < 3 or c % 3 else f"own {c % 7}") for c in range(400) for t in range(3 + c % 4)] + [(1000 + r[0], *r[1:]) for r in talk(5, 100, say=2)]
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == brute(rows)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sweeps_and_stitches_anywhere():
    """However sorted arrays are cut into ranges, and stretches into rounds, the nodes are the same."""
    rnd = random.Random(9)
    for trial in range(30):
        arrays = sorted(((bytes(b for t in range(rnd.randint(0, 4)) for b in [rnd.randint(0, 1)] * prefix_trie.WIDTH)), c) for c in range(25))
        cuts = sorted(rnd.sample(range(1, 25), rnd.randint(0, 8)))
        ranges = [arrays[a:b] for a, b in zip([0, *cuts], [*cuts, 25])]
        shared = [prefix_trie.common(a[-1][0], b[0][0]) for a, b in zip(ranges, ranges[1:])]
        rows = []
        for i, r in enumerate(ranges):
            sweep = prefix_trie.Sweep(i, r[-1][0], shared[i - 1] if i else -1, shared[i] if i < len(shared) else -1)
            for key, c in r:
                sweep.add(key, [1] * (len(key) // prefix_trie.WIDTH), c)
            sweep.pop(-1)
            rows += sweep.made
        closed, now = [r for r in rows if r["kind"] == "node"], [r for r in rows if r["kind"] == "open"]
        part = len(ranges) - 1
        while now and part >= 0:
            groups: dict = {}
            for r in now:
                groups.setdefault(r["part"] // 3, []).append(r | {"at": r["part"], "part": r["part"] // 3})
            made = [x for g in groups.values() for x in prefix_trie._stitched(prefix_trie.pa.Table.from_batches([prefix_trie._batch(g)])).to_pylist()]
            closed += [r for r in made if r["kind"] == "node"]
            now = [r for r in made if r["kind"] == "open"]
            part = part // 3 if part else -1
        want = nodes({c: [(key[i : i + prefix_trie.WIDTH], "w") for i in range(0, len(key), prefix_trie.WIDTH)] for key, c in arrays})
        key = lambda r: (r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
        assert not now and sorted(map(key, closed)) == sorted((r[0], r[1], *r[3:7]) for r in want)
