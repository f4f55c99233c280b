"""python -m veilmark COMMAND IN OUT [CONFIG] [--as FORM] [--lang LANGUAGE]: a folder of documents in, receipts out.

Commands and their forms, the first by default:
  observe    table, json, text, html
  catalog    table, json
  control    table, json, text; CONFIG is a vocabulary
  geometry   table, json, text; CONFIG are thresholds
  report     html, text, json, pdf
  dashboard  html
A table is a Parquet folder.  Of the others OUT becomes a folder of files: one receipt a document, named as it is below IN;
of pdf and dashboard a summary and all documents in parts.  The exit code is 0, or 1 if the call is wrong.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import contract, detect
from veilmark.operators import codepoints, control_syntax, geometry, report
from veilmark.sinks import pages, pdf_report, receipts
from veilmark.sources import formats, pdf, reading

FORMS = {
    "observe": ("table", "json", "text", "html"), "catalog": ("table", "json"), "control": ("table", "json", "text"),
    "geometry": ("table", "json", "text"), "report": ("html", "text", "json", "pdf"), "dashboard": ("html",),
}


def _segments(read: DataFrame) -> DataFrame:
    each = read.select(F.col("source").alias("doc_id"), F.posexplode("segments").alias("seg_no", "s"))
    return each.select("doc_id", "seg_no", "s.kind", "s.location", "s.text")


def _geometry(files: DataFrame, thresholds: geometry.Thresholds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages and PDF files, findings in them with their own and linked sheets, what was looked at in pages)."""
    sheets = files.filter("extension = '.css'").select(F.col("source").alias("path"), F.decode("content", "utf-8").alias("css"))
    table = geometry.declared(files.filter("extension in ('.html', '.htm')"), sheets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found, _ = pdf.audit(content.as_py(), thresholds.values["pdf_font_size_pt_max"])
                except ValueError:
                    continue
                rows += [(source, n, *f, *pdf.stated(*f[2:])) for n, f in enumerate(found)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string())
            columns = zip(*rows) if rows else ((),) * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["source", "no", "origin", "location", "rule", "measured", "property", "value"])

    pdfs = files.filter("extension = '.pdf'").select("source", "content").mapInArrow(run, "source string, no int, origin string, location string, rule string, measured array<double>, property string, value string")
    found = geometry.audit(table, thresholds.values).unionByName(pdfs, allowMissingColumns=True)
    return files.filter("extension <> '.css'").select("source"), found, geometry.scanned(table)


def _called(argv: list[str]) -> tuple[str, str, str, str | None, str, str] | None:
    """(command, folder, out, config, form, language) of a call; None if it is wrong."""
    words, options = [], {"--as": "", "--lang": "auto"}
    at = 0
    while at < len(argv):
        if argv[at] in options and at + 1 < len(argv):
            options[argv[at]] = argv[at + 1]
            at += 2
        else:
            words.append(argv[at])
            at += 1
    if len(words) not in (3, 4) or words[0] not in FORMS or (len(words) == 4 and words[0] not in ("control", "geometry")):
        return None
    form = options["--as"] or FORMS[words[0]][0]
    return (*words[:3], words[3] if len(words) == 4 else None, form, options["--lang"]) if form in FORMS[words[0]] else None


def main(argv: list[str]) -> int:
    call = _called(argv)
    if call is None:
        print(__doc__, file=sys.stderr)
        return 1
    command, folder, out, path, form, lang = call
    config = None
    if path is not None:
        with open(path, "rb") as given:
            config = given.read()
    try:
        vocabulary = control_syntax.vocabulary(config if command == "control" else None, path or "")
        thresholds = geometry.load(config if command == "geometry" else None, path or "")
    except contract.ContractError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("veilmark").getOrCreate()
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name, missing in formats.install("plain text", "HTML", "DOCX", "PDF", "pictures of PDF", "image metadata", "PNG layers", "text in pictures of PDF", "text in pictures").items():
        if missing:
            print(f"not available: {name} ({missing})", file=sys.stderr)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if command == "geometry":
        files = reading.scan(spark, folder, (".html", ".htm", ".pdf", ".css")).select("source", "extension", "content")
        sources, found, looked = _geometry(files, thresholds)
        if form == "table":
            found.orderBy("source", "part", "no", "sub", "nth").write.parquet(out)
        else:
            receipts.write(geometry.receipt(found, thresholds, sources, looked), out, form, form, base)
        return 0
    read = reading.extract(reading.scan(spark, folder))
    if command == "catalog":
        if form == "table":
            codepoints.catalog(read.select("source", detect.body_text(F.col("segments")).alias("text")), "text", "source").orderBy("doc_id", "first").write.parquet(out)
        else:
            receipts.write(receipts.catalogs(read), out, form, form, base)
    elif command == "control":
        if form == "table":
            hits = control_syntax.scan(_segments(read), vocabulary.table(spark), vocabulary.backing)
            hits.orderBy("doc_id", "seg_no", "offset", "pattern_no").write.parquet(out)
        else:
            receipts.write(receipts.control(read, vocabulary), out, form, form, base)
    else:
        observed = detect.observed(read, "segments", status="status", with_evidence=True)
        if form == "table":
            said = detect.diagnostics(detect.body_text(F.col("segments")), F.col("encoding"), F.col("counts"), F.col("status"))
            observed.select("source", "status", "o", "e", said.alias("diagnostics")).orderBy("source").write.parquet(out)
            return 0
        said_in = report.sample_language(read, lang)
        if command != "dashboard" and form != "pdf":
            receipts.write(receipts.observations(observed, said_in), out, form, form, base)
            return 0
        rows = observed.select("source", "o", "e").persist()
        if command == "dashboard":
            pages.dashboard(rows, out, base, said_in)
        else:
            pdf_report.write(rows, out, base, base, said_in)
        rows.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
