from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions import detect
from veilmark.operators import codepoints, control_syntax, report
from veilmark.sinks import files, pages, pdf_report
from veilmark.sources import pdf, reading


def written(folder):
    return {str(f.relative_to(folder)): f.read_bytes() for f in folder.rglob("*") if f.is_file() and not f.name.startswith(".")}


def observed(spark, rows):
    segments = F.array(F.struct(F.col("t").alias("text"), F.lit(True).alias("visible"), F.lit("body").alias("kind"), F.lit("line 1").alias("location"), F.lit(None).cast("string").alias("concealment")))
    made = spark.createDataFrame(rows, "source string, t string")
    return made.withColumn("segments", segments).select("source", detect.observe(F.col("segments")).alias("o"), detect.evidence(F.col("segments")).alias("e"))


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(50)], "name string, body binary")
    files.write(rows, str(tmp_path / "out"))
    made = written(tmp_path / "out")
    assert json.loads(made.pop("_SUCCESS")) == {"files": 50, "bytes": sum(range(50))} and made == {f"d{i % 3}/f{i}.bin": bytes([i]) * i for i in range(50)}
    files.write(rows.filter("name like 'd0%'").withColumn("body", F.lit("new")), f"file://{tmp_path}/out")
    again = written(tmp_path / "out")
    assert again["d0/f3.bin"] == b"new" and again["d1/f1.bin"] == b"\x01" and not (tmp_path / "out/_temporary").exists()


def test_what_fails_is_not_finished(spark, tmp_path):
    """A task that fails leaves whole files of the others at most, no marks of an end, and nothing half written; the next run mends it."""
    good = spark.createDataFrame([(f"{i}.txt", "x" * 1000) for i in range(20)], "name string, body string")
    files.write(good, str(tmp_path / "out"))

    @F.udf("string")
    def broken(name):
        if name == "13.txt":
            raise ValueError(name)
        return "y" * 1000

    with pytest.raises(Exception, match="13.txt"):
        files.write(good.repartition(5).withColumn("body", broken("name")), str(tmp_path / "out"))
    left = written(tmp_path / "out")
    assert "_SUCCESS" not in left and set(left) == {f"{i}.txt" for i in range(20)} and set(left.values()) <= {b"x" * 1000, b"y" * 1000}
    files.write(good, str(tmp_path / "out"))
    assert json.loads(written(tmp_path / "out")["_SUCCESS"])["files"] == 20


def test_names_stay_in_the_folder(spark):
    rows = spark.createDataFrame([("/c/d/e.txt",), ("/x/e.txt",), ("/y/e.txt",), ("/c/../../etc/p",), ("/c//a",), ("/c/a\nb\\c",)], "s string")
    found = [r[0] for r in rows.select(files.name_of(F.col("s"), "/c", ".json")).collect()]
    assert found[0] == "d/e.txt.json" and found[3:] == ["_/_/etc/p.json", "_/a.json", "a_b_c.json"]
    assert re.fullmatch(r"e\.txt-[0-9a-f]{16}\.json", found[1]) and found[1] != found[2]


def test_dashboard_of_any_size(spark, tmp_path):
    """Ten thousand rows in pages: none lost, in order, each page linked to its neighbours."""
    rows = [(f"/c/{i:05}<&>.txt", "plain" if i % 10 else "x​") for i in range(10_000)]
    random.Random(1).shuffle(rows)
    count = pages.dashboard(observed(spark, rows).repartition(12), str(tmp_path / "out"), "/c", size=300)
    made = {k: v.decode() for k, v in written(tmp_path / "out").items()}
    assert count == 34 and json.loads(made.pop("_SUCCESS"))["files"] == 35
    listed = [x for i in range(count) for x in re.findall(r'">(\d{5})&lt;&amp;&gt;\.txt</td><td>([01-]+)</td>', made[f"pages/{i + 1:09}.html"])]
    assert listed == [(f"{i:05}", "1000-000" if i % 10 else "1100-000") for i in range(10_000)]
    assert '<a href="000000006.html">' in made["pages/000000007.html"] and '<a href="000000008.html">' in made["pages/000000007.html"] and '<tr class="flagged">' in made["pages/000000001.html"]
    assert "10000" in made["index.html"] and 'href="pages/000000034.html"' in made["index.html"]
    assert pages.dashboard(observed(spark, []), str(tmp_path / "none")) == 0 and set(written(tmp_path / "none")) == {"index.html", "_SUCCESS"}


def test_pdf_report(spark, tmp_path):
    """The same bytes twice, whatever the partitions; evidence cut at 100; readable by the library's own reader."""
    rows = [(f"/c/{i}.txt", "Pаypаl" * 60 if i == 3 else "x​" if i % 2 else "plain") for i in range(40)] + [("/c/日本 (1).txt", "これ‮")]
    for folder, parts in (("a", 1), ("b", 7)):
        assert pdf_report.write(observed(spark, rows).repartition(parts), str(tmp_path / folder), "corpus", "/c") == 1
    made = written(tmp_path / "a")["report.pdf"]
    assert made == written(tmp_path / "b")["report.pdf"] and made.endswith(b"%%EOF\n")
    found = pdf.pdf(made, reading.Limits())
    text = "\n".join(s.text for s in found if s.kind == "body")
    assert all(s.kind == "body" for s in found) and "total: 41" in text and "日本 (1).txt" in text and "1100-000" in text and "39.txt" in text and "1 / 1" in text
    assert max(len(r["evidence"]) for r in pages.rows(observed(spark, rows), None, 1, 100).collect()) == 100
    offsets = [int(m) for m in re.findall(rb"(\d{10}) 00000 n", made)]
    assert all(made[o:].startswith(b"%d 0 obj" % n) for n, o in enumerate(offsets, 1)) and int(re.search(rb"startxref\n(\d+)", made)[1]) == made.index(b"xref\n0 ")
    assert pdf_report.write(observed(spark, rows), str(tmp_path / "c"), "corpus", "/c", charts=False, part_rows=10) == 5
    parts = written(tmp_path / "c")
    names = [f"parts/{i:09}.pdf" for i in range(1, 6)]
    assert set(parts) == {"report.pdf", "_SUCCESS", *names} and "5 parts" in "".join(s.text for s in pdf.pdf(parts["report.pdf"], reading.Limits()))
    whole = "".join(s.text for n in names for s in pdf.pdf(parts[n], reading.Limits()))
    assert all(f"\n{i}.txt" in whole for i in range(40))


def test_hits_are_ordered_by_place(spark):
    """By segment, then offset, then pattern, as a reader meets them."""
    used = control_syntax.vocabulary()
    rows = [(1, 0, "body", "line 1", "[OVERRIDE] x <|im_end|> [INST] <|im_start|> [INST] <|im_end|>"), (1, 1, "body", "line 2", "[OVERRIDE]")]
    hits = control_syntax.scan(spark.createDataFrame(rows, "doc_id long, seg_no int, kind string, location string, text string"), used.table(spark), used.backing)
    (row,) = control_syntax.receipt(hits, used).collect()
    assert [f["offset"] for f in json.loads(row.json)["findings"]] == [0, 13, 24, 31, 44, 51, 0]
    assert report.receipt({"a": "é"}) == '{\n  "a": "é"\n}\n'


def test_code_points_by_row(spark):
    """Rows of one id are texts of their own, and a text full of what is looked for is searched in linear time."""
    many = "\u200b" * 300_000 + "\u0430"
    rows = [(1, "a\u200bb\u202ec\u200b"), (1, "\u0430\u200b"), (2, "\ufeff\u200bx"), (3, "plain é"), (4, None), (None, "\U000e0041 \u200b"), (5, many)]
    made = codepoints.catalog(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((repr(r.doc_id), r.codepoint, r.kind, r["count"], list(r.positions), r.twin, r["first"]) for r in made if r.doc_id != 5)
    assert found == sorted([
        ("1", "U+200B", "H2", 2, [1, 5], None, 1), ("1", "U+202E", "H3", 1, [3], None, 3), ("1", "U+0430", "homoglyph", 1, [0], "U+0061", 0), ("1", "U+200B", "H2", 1, [1], None, 1),
        ("2", "U+200B", "H2", 1, [0], None, 0), ("None", "U+E0041", "H7", 1, [0], None, 0), ("None", "U+200B", "H2", 1, [2], None, 2),
    ])
    assert sorted((r.codepoint, r["count"], r["first"]) for r in made if r.doc_id == 5) == [("U+0430", 1, 300_000), ("U+200B", 300_000, 0)]


def test_many_patterns_at_once(spark):
    """Ten thousand literal patterns and a few expressions: the same hits as a search for each, at not much more than the cost of few."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6))) for _ in range(10_000)]
    patterns = [(i, "c", f"n{i}", w if i % 3 else w.upper(), "literal", i % 5 == 0) for i, w in enumerate(words)] + [(10_000, "c", "overlap", "aa", "literal", True), (10_001, "c", "regex", r"b\w+d", "regex", False), (10_002, "c", "empty", "", "literal", True)]
    vocabulary = spark.createDataFrame(patterns, "pattern_no int, category string, name string, pattern string, match string, case_sensitive boolean")
    texts = [" ".join(rnd.choice(words) if rnd.random() < 0.8 else "AaaaA" for _ in range(40)) for _ in range(30)] + ["", None]
    segments = spark.createDataFrame([(i, 0, "body", "", t) for i, t in enumerate(texts)], "doc_id long, seg_no int, kind string, location string, text string")
    found = {(r.doc_id, r.pattern_no, r.offset) for r in control_syntax.scan(segments, vocabulary).collect()}
    want = set()
    for d, t in enumerate(texts):
        for number, _, _, pattern, match, exact in patterns:
            if match == "regex":
                want |= {(d, number, m.start()) for m in re.finditer(pattern, t or "", re.IGNORECASE)}
                continue
            text, pattern = (t or "", pattern) if exact else ((t or "").lower(), pattern.lower())
            at = text.find(pattern) if pattern else -1
            while at >= 0:
                want.add((d, number, at))
                at = text.find(pattern, at + len(pattern))
    assert found == want and len(want) > 1000
    big = " ".join(rnd.choice(words) for _ in range(200_000))
    took = []
    for own in (patterns[:14], patterns[:10_001]):
        literals = control_syntax.Literals([(p[3], p[5]) for p in own])
        began = time.perf_counter()
        literals.find("x" * 2_000_000 + big[:1000])
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.5
