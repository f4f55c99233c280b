from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
from veilmark.plans import catalog
from veilmark.sources import css, reading

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    made = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows(made.columns, map(tuple, made.collect())) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def same_as_sql(spark, folder, name, values):
    """Whether a query and its SQL agree on documents (doc_id, text); the rows."""
    spark.createDataFrame(values, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    made, found = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    own = rows(made.columns, map(tuple, made.collect()))
    assert own == rows(columns, found.fetchall())
    return own


def test_densities_between_two_places(spark, tmp_path):
    found = same_as_sql(spark, tmp_path, "diagnostics", [(0, "\u200b" + "a" * 799), (28, "\u200b" + "a" * 31), (14, "\u200b" * 3 + "a" * 4), (42, None)])
    assert sorted(r[0] for r in found) == [0, 13, 313, 4286]


def test_painted_ground_is_as_wide_as_the_longest_line(spark, tmp_path):
    long = "wide line " * 2_500
    found = same_as_sql(spark, tmp_path, "pdf_pages", [(2, long), (8, "short\n" * 40 + long), (14, None), (1, long)])
    assert len(found) == 4


def test_page_segments_equal_sql_on_cut_off_references_with_any_reader(spark, tmp_path):
    cut = [f"<title>Token = {end}</title>\n<!-- R&D &quot &amp comment --><script>a &quot b</script><p>x &quot;y&quot; &copy; &middot; R&amp;D &lt;b&gt; {end}</p>" for end in ("&quot", "&quo", "&amp", "&am", "&", "&quot;", "&copy", "&amp;quot;")]
    spark.createDataFrame([*enumerate([*cut, None])], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(catalog.ORACLES["html_segments"])
    columns, want, before = [c[0] for c in found.description], found.fetchall(), reading.registered(".html")
    for put in (lambda: None, lambda: css.install(full=True)):
        put()
        try:
            made = catalog.QUERIES["html_segments"](spark, str(tmp_path))
            own = rows(made.columns, map(tuple, made.collect()))
        finally:
            reading.register([".html", ".htm"], before)
        assert own == rows(columns, want)


def test_slices():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["i"]) for n in (0, 1, 64, 1_000)]
    found = list(reading.sliced(iter(batches)))
    assert max(b.num_rows for b in found) == reading.SLICE_ROWS and [i for b in found for i in b.column(0).to_pylist()] == [i for b in batches for i in b.column(0).to_pylist()]


#: Queries that make files of documents.
ONE_PASS = ["docx_observe", "docx_segments", "encoding_policy", "image_layers", "image_metadata", "pdf_declared", "pdf_geometry", "pdf_hidden_kinds", "pdf_pages", "pdf_pictures", "pdf_samples", "pdf_segments", "picture_layers"]


@pytest.mark.parametrize("name", ONE_PASS)
def test_files_are_read_where_they_are_made(spark, name):
    """Files of a whole Arrow batch would lie in one Python process after the other."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_files_that_are_written_where_they_are_read(spark):
    """What ``write`` gives is judged as a file's own content is."""
    made = spark.createDataFrame([(1, ".txt", "a"), (2, ".txt", "b" * 9), (3, ".pdf", "no"), (4, ".x", ""), (5, ".txt", None)], "id long, extension string, content string")
    found = reading.extract(made, reading.Limits(file_bytes=8), write=lambda t: (t or "none").encode()).orderBy("id").collect()
    assert list(found[0].asDict()) == ["id", "extension", "status", "encoding", "counts", "segments"]
    assert [r.status for r in found] == ["ok", "Extraction refused: file_too_large", "Extraction failed: ValueError", "Unsupported format: .x", "ok"]
    assert [[s.text for s in r.segments] for r in found] == [["a"], [], [], [], ["none"]]
