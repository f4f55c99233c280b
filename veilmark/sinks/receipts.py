"""Receipts of a folder's documents, one file each: what each lane says of a document, as JSON, text or HTML."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import detect
from veilmark.operators import codepoints, control_syntax, geometry, report
from veilmark.sinks import files

#: Endings of receipts' names, after the document's own.
ENDINGS = {"json": ".json", "text": ".txt", "html": ".html"}


def indented(rows: DataFrame) -> DataFrame:
    """rows (name, body: JSON) as receipts hold it: indented by two, not escaped, ended by a line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [report.receipt(json.loads(b)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], ["name", "body"])

    return rows.select("name", "body").mapInArrow(run, "name string, body string")


def write(rows: DataFrame, folder: str, body: str, kind: str, base: str | None = None) -> None:
    """rows (source and the column ``body``) as files; the kind says how their names end and whether they are JSON."""
    made = rows.select(files.name_of(F.col("source"), base, ENDINGS[kind]).alias("name"), F.col(body).alias("body"))
    files.write(indented(made) if kind == "json" else made, folder)


def observations(observed: DataFrame, lang: str = "en") -> DataFrame:
    """source, json, text, html of observed documents (source, status, encoding, counts, segments, o, e)."""
    said = detect.diagnostics(detect.body_text(F.col("segments")), F.col("encoding"), F.col("counts"), F.col("status"))
    o, e = F.col("o"), F.col("e")
    states = F.struct(*(o[f"h{i}"].alias(f"H{i}") for i in range(1, 8)))
    lines = F.struct(*(e[f"h{i}"].alias(f"H{i}") for i in range(1, 8)))
    whole = _joined({"source": F.to_json(F.struct("source")), "mask": F.to_json(F.struct(o["mask"].alias("mask"))), "h_states": _named("h_states", states), "evidence": _named("evidence", lines)}, diagnostics=said)
    return observed.select("source", whole.alias("json"), report.text_report(F.col("source"), o, e, lang).alias("text"), report.html_report(F.col("source"), o, e, F.col("segments"), lang).alias("html"))


def _named(name: str, value: Column) -> Column:
    return F.to_json(F.struct(value.alias(name)))


def _joined(parts: dict[str, Column], **texts: Column) -> Column:
    """One JSON object of objects of a key each, and of keys whose values are JSON texts."""
    inner = [F.regexp_replace(p, r"^\{|\}$", "") for p in parts.values()]
    inner += [F.concat(F.lit(f'"{k}":'), t) for k, t in texts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def catalogs(read: DataFrame) -> DataFrame:
    """source, json: the code points of every document that could be read, none of most."""
    own = read.filter("status = 'ok'").select("source", detect.body_text(F.col("segments")).alias("text"))
    found = codepoints.catalog(own, "text", "source")
    entry = F.struct("first", "kind", "codepoint", "count", "positions", "twin")
    each = found.groupBy(F.col("doc_id").alias("source")).agg(F.sort_array(F.collect_list(entry)).alias("found"))
    kept = F.transform(F.coalesce("found", F.array().cast(each.schema["found"].dataType)), lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "codepoint", "count", "positions", "twin"))))
    told = F.to_json(F.struct(F.lit("veilmark").alias("lens"), F.lit(1).alias("version"), kept.alias("observations")))
    return own.select("source").join(each, "source", "left").select("source", told.alias("json"))


def control(read: DataFrame, used: control_syntax.Vocabulary) -> DataFrame:
    """source, json, text: the control lane's receipt of every document that could be read."""
    own = read.filter("status = 'ok'")
    segments = own.select(F.col("source").alias("doc_id"), F.posexplode("segments").alias("seg_no", "s")).select("doc_id", "seg_no", "s.kind", "s.location", "s.text")
    hits = control_syntax.scan(segments, used.table(read.sparkSession), used.backing)
    return control_syntax.receipt(hits, used, own.select(F.col("source").alias("doc_id"))).withColumnRenamed("doc_id", "source")


def placed(findings: DataFrame, thresholds: geometry.Thresholds, sources: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """source, json, text: the geometry lane's receipt of every page in sources."""
    return geometry.receipt(findings, thresholds, sources, scanned)
