from __future__ import annotations

import random

import pytest

#: Extra columns named as the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, digest string, size long, kept string, anchor string, repeats string"


def table(spark, rows, schema=SCHEMA):
    """rows (doc_id, text[, lang[, source]]) as a documents table with clashing extra columns."""
    full = [(*r, *("en", "s0")[len(r) - 2 :], len(r[1] or ""), 7, "d", 1, "k", "a", "r") for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and other scripts."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "ion", "é", "日本", "x", "ab", "zu"]) for _ in range(rnd.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three")]
    base = []
    for i in range(6, 60):
        words = [word() for _ in range(rnd.choice([3, 10, 50, 200]))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        base.append(" ".join(words))
        rows.append((i, base[-1]))
    for i in range(60, 100):
        words = rnd.choice(base).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, rnd.choice([" ", "\n"]).join(words)))
    rows.append((100, "aaaa " * 3000))
    rows.append((101, "a" * 30_000))
    rnd.shuffle(rows)
    return rows
