"""The catalog of invisible characters and look-alikes: where each code point stands in each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.functions import chars, detect


def catalog(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, kind, codepoint, count, positions, twin, first: a row for each code point found in a row of docs.

    Built-in tests decide which documents hold any; only these are searched, as arrays of code points, since no built-in
    expression sums up lengths within a value in linear time.  A row's characters are gathered where the row is: nothing is
    shuffled, and rows of one id stay apart.  ``first`` gives the order of first appearance.
    """
    every = chars.one_of(chars.INVISIBLE)
    inside = f"{every[1:-1]}{''.join(chars.LOOKALIKES)}"
    wanted = np.array(sorted({*chars.points(chars.INVISIBLE), *map(ord, chars.LOOKALIKES)}), np.uint32)
    own = docs.select(docs[id_col].alias("doc_id"), detect.without_leading_bom(docs[text]).alias("text"))
    own = own.filter(~detect.only_ascii(F.col("text"))).filter(F.col("text").rlike(f"[{inside}]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                codes = np.frombuffer(value.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                at = np.flatnonzero(np.isin(codes, wanted))
                order = np.argsort(codes[at], kind="stable")
                code, at = codes[at][order], at[order].astype(np.int32)
                new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)], pa.int32()), pa.array(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(new), row))), pa.array([chr(c) for c in code[new].tolist()], pa.string()), places], ["doc_id", "c", "positions"])

    each = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, c string, positions array<int>")
    kind = F.when(F.col("c").rlike(chars.one_of(chars.ZERO_WIDTH)), "H2").when(F.col("c").rlike(chars.one_of(chars.BIDI)), "H3").when(F.col("c").rlike(every), "H7").otherwise("homoglyph")
    point = lambda c: F.concat(F.lit("U+"), F.format_string("%04X", F.ascii(c)))
    twin = F.when(kind == "homoglyph", point(F.translate("c", chars.LOOKALIKES, chars.LOOKALIKE_OF)))
    return each.select("doc_id", kind.alias("kind"), point(F.col("c")).alias("codepoint"), F.size("positions").cast("long").alias("count"), "positions", twin.alias("twin"), F.element_at("positions", 1).alias("first"))
