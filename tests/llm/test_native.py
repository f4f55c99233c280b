from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, table
from veilmark.llm import license_scan, mixture, secret_scan, staging, stream_dedup

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(found)]


KEY = "AKIA" + "A1B2" * 4
SECRETS = [
    (1, None), (2, ""), (3, "😀 password = 'abcdefgh' é token:short secret=\"x.y-z/w+q_=\""), (4, f"id {KEY} and {KEY}"), (5, "f" * 32 + " " + "e" * 31), (6, "AKIA" + "A" * 11),
    (7, "token=secret: abcdefghij password==abcdefgh API_KEY:ABCDEFGHIJ apikey = 12345678"), (8, ("password=abcdefgh " + "a" * 40 + "\n") * 400), (None, "passwd:12345678"), (8, "dup id token=12345678"), (3, "😀 password = 'abcdefgh' é token:short secret=\"x.y-z/w+q_=\""), (9, "token = ſecret"),
]


def test_base_secrets(spark):
    rows = SECRETS + [SECRETS[3]] * 3
    found = secret_scan.report(table(spark, rows)).collect()
    want = []
    for doc_id, text in rows:
        spans = base_spans(text or "")
        count = lambda k: sum(s.startswith(k) for s in spans)
        want.append((doc_id, count("assign"), count("access"), count("hex"), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in found)
    assert secret_scan.report(table(spark, [])).count() == 0


def test_linking(spark):
    weak = "Zx9" * 8
    far = "word " * 100
    rows = [
        (1, f"key {KEY} then {weak} at https://host.example/x"), (2, f"only {weak} here"), (3, f"{KEY} {far} {weak}"), (4, "login: bob password: hunter2hunter2 https://a.example/"),
        (5, "login: bob https://a.example/"), (6, f"user=alice {weak}"), (7, "see https://a.example/ password=abcdefgh"),
    ]
    spans = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secret_scan.report(table(spark, rows)).collect()}
    assert spans == {1: ["access", "opaque", "endpoint"], 2: [], 3: ["access"], 4: ["ident", "assign", "endpoint"], 5: [], 6: ["ident", "opaque"], 7: ["assign"]}


def seats(votes, n):
    """Sainte-Lague by the book."""
    got = {k: 0 for k in votes}
    for _ in range(n):
        best = max((v / (2 * got[k] + 1), -k) for k, v in votes.items() if v)
        got[-best[1]] += 1
    return got


def test_own_complements(spark):
    """No string is its own complement, nor is a path the secret of its address."""
    rows = [(1, "login: JohnSmith1234567890abcdEF"), (2, "user=bob see https://host.example/Assets1234567890abcdEFGH"), (3, "user=bob key Assets1234567890abcdEFGH https://host.example/"), (4, "x" * 3000 + " user=bob " + "y " * 200 + "Assets1234567890abcdEFGH")]
    found = {r.doc_id: r.spans for r in secret_scan.report(table(spark, rows)).collect()}
    assert found[1] == found[2] == found[4] == ""
    assert [x.split(":")[0] for x in found[3].split(",")] == ["ident", "opaque", "endpoint"]


def test_apportion(spark):
    rnd = random.Random(3)
    for _ in range(6):
        votes = {i: rnd.choice([0, 1, 5, 5, 40, 1000]) for i in range(rnd.randint(1, 12))}
        votes[0] = 3
        for n in (0, 1, 7, 100):
            parties = spark.createDataFrame([(i, v, n, 1) for i, v in votes.items()], "i int, v long, n long, g int")
            found = {r.i: r.quota for r in mixture.apportion(parties, ["g"], "v", "n", [F.col("i")]).collect()}
            assert found == seats(votes, n), (votes, n)
            found = {r.i: r.quota for r in mixture.apportion_all(parties, "i", "v", n).collect()}
            assert found == seats(votes, n), (votes, n)


def filled(sizes, weights, total):
    out, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixture(spark):
    rnd = random.Random(4)
    rows, sources = [], ["b", "a", "é", None, "z", "𐀀", ""]
    for i in range(900):
        source = rnd.choice(sources[:2] * 8 + sources)
        rows.append((i, " ".join("w" for _ in range(rnd.choice([0, 1, 30, 200]))) if i % 50 else None, "en", source))
    rows += [(900, "x " * 20_000, "en", "z"), (5, "repeated id", "en", "a"), (None, "no id", "en", "a"), (5, "repeated id", "en", "a")]
    docs = table(spark, rows)
    found = mixture.report(docs).collect()
    assert len(found) == len(rows)
    assert sorted(map(repr, found)) == sorted(map(repr, mixture.report(docs.repartition(5)).collect()))
    size, by_text = {s: 0 for s in sources}, {}
    for _, text, _, source in rows:
        size[source] += len((text or "").split())
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = filled(size, weights, 1.5 * sum(size.values()))
    taken = dict.fromkeys(sources, 0)
    source_of = {}
    for doc_id, text, _, source in rows:
        source_of[doc_id, len((text or "").split())] = source
    for r in found:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == size[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= mixture.BLOCK_WORDS, s
    made = mixture.sample(docs)
    assert made.columns == docs.columns
    assert made.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(mixture.WORD), F.lit(0))))).first()[0] == sum(taken.values())
    same = table(spark, [(i, "w " * 64, "en", "a") for i in (1, 1, 1, None, None, 2)] + [(3, "w " * 6400, "en", "b")])
    planned = mixture.report(same).agg(F.sum("taken")).first()[0]
    drawn = mixture.sample(same).select(F.sum(F.size(F.regexp_extract_all("text", F.lit(mixture.WORD), F.lit(0))))).first()[0]
    assert planned == drawn
    assert mixture.report(table(spark, [])).count() == 0 and mixture.sample(table(spark, [])).count() == 0


def test_licenses(spark):
    isc = dict(license_scan.KNOWN)["ISC"]
    rows = [
        (1, "Released under the MIT Licence."), (2, "words\n  RELEASED under the mit license\nmore"), (3, "We wrote that it was Released under the MIT License. today"), (4, None), (5, ""),
        (6, "Copyright (c) 2020 Someone\n\n" + isc.replace(". ", ".\n")), (7, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (None, "x"),
    ]
    found = {r.doc_id: (r.doc_license, r.licenses) for r in license_scan.scan(table(spark, rows)).collect()}
    assert found == {1: ("MIT", ["MIT"]), 2: (None, ["MIT"]), 3: (None, []), 4: (None, []), 5: (None, []), 6: ("ISC", ["ISC"]), 7: (None, ["Apache-2.0", "CC-BY-NC-4.0"]), None: (None, [])}
    assert license_scan.scan(table(spark, [])).count() == 0


def test_licenses_in_long_and_repeated_rows(spark):
    """A notice at the end of a very long text, under many copyright lines, and in rows that occur several times."""
    isc = dict(license_scan.KNOWN)["ISC"]
    lines = "".join(f"Copyright (c) {1900 + i} The Owners of Part {i}\n" for i in range(80))
    rows = [(1, "word " * 200_000 + "\nReleased under the MIT License.")] * 2 + [(None, lines + isc.replace(". ", ".\n")), (None, lines + isc.replace(". ", ".\n"))]
    found = sorted(((str(r.doc_id), ",".join(r.licenses), r.n_units) for r in license_scan.scan(table(spark, rows)).collect()))
    assert found == [("1", "MIT", 1)] * 2 + [("None", "ISC", 1)] * 2


def test_whole_licenses(spark):
    want = {"BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Unlicense", "Zlib", "Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"}
    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {f.stem: f.read_text("utf-8") for f in folder.glob("*.txt")}
    assert set(texts) == want
    names = sorted(want)
    rows = [(i, texts[n].upper().replace("\n", "\n  ")) for i, n in enumerate(names)] + [(100, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + texts["MIT"])]
    found = {r.doc_id: (r.doc_license, r.licenses) for r in license_scan.scan(table(spark, rows)).collect()}
    assert {i: x[0] for i, x in found.items()} == dict(enumerate(names)) | {100: "MIT"}
    assert all(x[0] in x[1] for x in found.values())


def test_long_headers(spark):
    """Neither copyright lines nor padding of any length hide a notice, nor does a wording without the usual words."""
    isc = dict(license_scan.KNOWN)["ISC"]
    header = "".join(f"Copyright (c) {1980 + i} A contributor with a rather long name and address\n" for i in range(60))
    boxed = "\n".join(f"*{line:>2000}{'*' * 2000}" for line in isc.split(". "))
    rows = [(1, "before\n\n" + header + isc.replace(". ", ".\n") + "\n\nafter"), (2, "before\n\n" + boxed + "\n\nafter"), (3, "before\n\nnothing\nof it\n\nafter")]
    found = {r.doc_id: r.licenses for r in license_scan.scan(table(spark, rows), texts=license_scan.KNOWN).collect()}
    assert found == {1: ["ISC"], 2: ["ISC"], 3: []}
    own = (("WTFPL", "Do what you want to."), ("X", "-- use -- per cent -- "))
    rows = [(1, "a\nDO WHAT you want to\nb"), (2, "a\nuse percent\nb"), (3, "a\nb")]
    assert {r.doc_id: r.licenses for r in license_scan.scan(table(spark, rows), texts=own).collect()} == {1: ["WTFPL"], 2: ["X"], 3: []}


COPIES = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (2, "a"), (6, "A"), (None, "only"), (7, "x" * 100_000), (8, "x" * 100_000)]


NOTICES = (
    "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n", "Copyright (c) Jane Doe\n\n", "Copyright Jane Doe and others\n\n", "Copyright (c) 2019-2021\nJane Doe\n\n", "Copyright © 2020 Jane Doe,\nJohn Roe\n\n",
    "Copyright (c) 2018 Jane Doe\nCopyright (c) 2019 John Roe\nand the Foo authors. All Rights Reserved\n\n", "Copyright (C) 2020 Jane Doe\n                   John Roe\n\n", "(c) 2020 Jane Doe <j@x.org>\n\n", "SPDX-FileCopyrightText: 2020 Jane Doe\n\n",
    "copyright 2020 jane doe\n\n", "Copyright (c) <year> <copyright holders>\n\n", "Copyright [yyyy] [name of copyright owner]\n\n", "COPYRIGHT (C) 2020 JANE DOE. ALL RIGHTS RESERVED.\n\n",
)


def test_notices_of_any_form(spark):
    """Every known text under every form of notice, plain, in a comment and indented; with a title where it is known with one."""
    rows, want = [], []
    for name, text in license_scan.FULL:
        titled = text.startswith(tuple(f"{t}\n\n" for _, t in license_scan.TITLES))
        for notice in NOTICES:
            title, _, rest = text.partition("\n\n") if titled else ("", "", text)
            whole = (f"{title}\n\n" if titled else "") + notice + rest
            for made in (whole, "/*\n" + "\n".join(f" * {line}" for line in whole.split("\n")) + "\n */", "\n".join(f"    {line}" for line in whole.split("\n"))):
                rows.append((len(rows), made))
                want.append(name)
    found = {r.doc_id: r.doc_license for r in license_scan.scan(table(spark, rows)).collect()}
    missed = {(want[i], rows[i][1][:60]) for i in found if found[i] != want[i]}
    assert not missed, sorted(missed)[:5]
    other = [(0, "Copyright holders may sue.\nReleased under the MIT License."), (1, "Copyright (c) 2020 X\nReleased under the MIT License."), (2, "(c) You must keep it\nReleased under the MIT License.")]
    assert [r.doc_license for r in license_scan.scan(table(spark, other)).orderBy("doc_id").collect()] == [None, "MIT", None]


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda c: F.sha2((F.length(c) % 2).cast("string"), 256)])
def test_copies(spark, digest):
    """Also with a digest that different texts share."""
    found = stream_dedup.decisions(table(spark, COPIES), digest=digest).collect()
    best, size = {}, {}
    for doc_id, text in COPIES:
        best[text or ""] = max(best.get(text or "", -1), -1 if doc_id is None else doc_id)
        size[text or ""] = size.get(text or "", 0) + 1
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted(repr((i, None if best[t or ""] < 0 else best[t or ""], size[t or ""], sha(t))) for i, t in COPIES)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(best) and len({r.text_sha256 for r in kept}) == len(best) and all(r.doc_id == r.keep_id for r in kept)
    docs = table(spark, COPIES)
    left = stream_dedup.keep(docs, digest=digest)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted(best)


def test_copies_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert stream_dedup.decisions(empty).count() == 0 and stream_dedup.keep(empty).count() == 0


def test_state_goes_on(spark, tmp_path):
    """A second run over a folder reads only new files and continues the state."""
    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    schema = "digest string, doc_id long, locator struct<file:string,row:long>"
    rows = lambda ids: spark.createDataFrame([(d, i, ("f", i)) for d, i in ids], schema)
    rows([("a", 1), ("b", 2)]).write.parquet(feed)
    assert stream_dedup.fold(spark.read.parquet(feed), checkpoint=state).count() == 0
    rows([("a", 3), ("c", 4)]).write.mode("append").parquet(feed)
    found = stream_dedup.fold(spark.read.parquet(feed), files_per_trigger=1, checkpoint=state).collect()
    assert [(r.digest, r.keeper.doc_id, r.group_size) for r in found] == [("a", 3, 2)]


def test_staging_releases(spark):
    """What is staged in a context goes with it, and nothing else."""
    with staging.owned([]) as mine:
        staging.stage(spark.range(3), "x")
    with staging.owned([]) as other:
        staging.stage(spark.range(4), "y")
    (_, path), (_, kept) = mine[0], other[0]
    assert spark.read.parquet(path).count() == 3
    staging.release(mine)
    assert not mine and spark.read.parquet(kept).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    staging.release(other)
