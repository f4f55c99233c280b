"""The observations as column expressions, over an ordered array of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import chars

VERSION = "0.2"
SEGMENT = "struct<text:string,visible:boolean,kind:string,location:string,concealment:string>"
BODY_KINDS = ("body", "css_hidden", "docx_hidden")
HIDDEN_KINDS = ("css_hidden", "docx_hidden")
OUT_OF_BAND_KINDS = ("comment", "metadata", "hidden_attr", "header_footer", "footnote")
_WS = chars.inside(chars.WHITE_SPACE)
_L, _CG = chars.one_of(chars.LATIN), chars.one_of(chars.CYRILLIC, chars.GREEK)
_INV = chars.one_of(chars.INVISIBLE)
MIXED_TOKEN = f"{_L}[^{_WS}]*{_CG}|{_CG}[^{_WS}]*{_L}"


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's definition."""
    return F.regexp_replace(text, rf"^[{_WS}]+|[{_WS}]+$", "")


def without_leading_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def body_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["kind"].isin(*BODY_KINDS)), lambda s: s["text"]), "")


def zero_width_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(chars.one_of(chars.ZERO_WIDTH)))


def zero_width_density(text: Column) -> Column:
    return F.coalesce(F.try_divide(zero_width_count(text).cast("double"), F.length(text).cast("double")), F.lit(0.0))


def has_bidi(text: Column) -> Column:
    return text.rlike(chars.one_of(chars.BIDI))


def only_ascii(text: Column) -> Column:
    """Such a text holds nothing that is looked for in body texts; a comparison of two lengths says so."""
    return F.octet_length(text) == F.length(text)


def has_mixed_script(text: Column) -> Column:
    """Two cheap tests first: the token pattern is quadratic on long tokens."""
    return text.rlike(_CG) & text.rlike(_L) & text.rlike(MIXED_TOKEN)


def mixed_tokens(text: Column, known: Column | None = None) -> Column:
    """``known``: whether there are any, where that has been found out already."""
    tokens = F.filter(F.split(text, rf"[{_WS}]+"), lambda t: t.rlike(_CG) & t.rlike(_L))
    return F.when(has_mixed_script(text) if known is None else known, tokens).otherwise(F.array().cast("array<string>"))


def has_payload(text: Column, least: int = 16) -> Column:
    return text.rlike(f"{_INV}{{{least}}}")


def invisible_runs(text: Column, least: int = 16, known: Column | None = None) -> Column:
    """array<struct<start, size, run>> of runs of invisible characters, in order; ``known`` as in ``mixed_tokens``."""
    pieces = F.regexp_extract_all(text, F.lit(f"{_INV}+|[^{_INV[1:-1]}]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int,run:string>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        size = F.length(piece)
        found = F.when((size >= least) & piece.rlike(f"^{_INV}"), F.concat(state["found"], F.array(F.struct(state["at"].alias("start"), size.alias("size"), piece.alias("run"))))).otherwise(state["found"])
        return F.struct((state["at"] + size).alias("at"), found.alias("found"))

    return F.when(has_payload(text, least) if known is None else known, F.aggregate(pieces, start, step)["found"]).otherwise(start["found"])


def decode_payload(text: Column) -> Column:
    """What zero-width characters spell as bits (U+200B 0, U+200C 1), if that is printable ASCII; else their number."""
    bits = F.translate(F.regexp_replace(text, chars.none_of(chars.ZERO_WIDTH), ""), "​‌‍⁠﻿", "01___")
    n = F.length(bits)
    codes = F.transform(F.regexp_extract_all(bits, F.lit("[01]{8}"), F.lit(0)), lambda b: F.conv(b, 2, 10).cast("int"))
    readable = ~bits.contains("_") & (n % 8 == 0) & F.forall(codes, lambda c: (c >= 32) & (c < 127))
    said = F.array_join(F.transform(codes, lambda c: F.chr(c)), "")
    return F.when(n == 0, "").when(readable, said).otherwise(F.concat(n.cast("string"), F.lit(" zero-width chars")))


def quoted(token: Column) -> Column:
    """A token without white space as a Python literal: quoted, what can't be printed escaped."""
    escape = lambda c: F.when(F.ascii(c) < 0x100, F.format_string("\\x%02x", F.ascii(c))).when(F.ascii(c) < 0x10000, F.format_string("\\u%04x", F.ascii(c))).otherwise(F.format_string("\\U%08x", F.ascii(c)))
    double = F.contains(token, F.lit("'")) & ~F.contains(token, F.lit('"'))
    mark = F.when(double, '"').otherwise("'")
    plain = F.replace(token, F.lit("\\"), F.lit("\\\\"))
    plain = F.when(double, plain).otherwise(F.replace(plain, F.lit("'"), F.lit("\\'")))
    each = F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(r"[\p{C}\p{Z}]"), escape(c)).otherwise(c))
    return F.concat(mark, F.when(plain.rlike(r"[\p{C}\p{Z}]"), F.array_join(each, "")).otherwise(plain), mark)


def _struct(ok: Column, tests: list[Column]) -> Column:
    ints = [F.coalesce(ok & b, F.lit(False)).cast("int") for b in (F.lit(True), *tests)]
    return F.struct(*(b.alias(f"h{i}") for i, b in enumerate(ints, 1)), F.concat(*ints[:4], F.lit("-"), *ints[4:]).alias("mask"))


def _hidden(segments: Column) -> Column:
    return F.exists(segments, lambda s: s["kind"].isin(*HIDDEN_KINDS))


def _meaningful(least: int):  # noqa: ANN202
    return lambda s: s["kind"].isin(*OUT_OF_BAND_KINDS) & (F.length(strip(s["text"])) >= least)


def observe(segments: Column, status: Column | None = None, density: float = 0.01, payload: int = 16, out_of_band: int = 10) -> Column:
    """struct<h1..h7, mask>; ``status`` is 'ok' or says why nothing could be extracted.

    One expression, for the use inside others; ``observed`` computes what the tests share only once.
    """
    text = body_text(segments)
    tests = [zero_width_density(text) >= density, has_bidi(text), _hidden(segments), F.exists(segments, _meaningful(out_of_band)), has_mixed_script(text), has_payload(text, payload)]
    return _struct(F.lit(True) if status is None else status == "ok", tests)


def _evidence(text: Column, segments: Column | None, zero_width: Column, bidi: Column, mixed: Column, runs: Column, payload: int, out_of_band: int) -> Column:
    """struct<h1..h7: array<string>>; an observation without evidence says "none"."""
    none = F.array().cast("array<string>")
    or_none = lambda lines: F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("none")))
    place = lambda s, other: F.coalesce(F.nullif(s["location"], F.lit("")), F.lit(other))
    number = lambda n: F.concat(n.cast("string"), F.lit(" zero-width chars"))
    if segments is None:
        h2, h4, h5 = F.array(number(zero_width)), none, none
    else:
        dense = F.filter(segments, lambda s: s["kind"].isin(*BODY_KINDS) & (zero_width_count(s["text"]) > 0))
        h2 = F.transform(dense, lambda s: F.concat(number(zero_width_count(s["text"])), F.coalesce(F.concat(F.lit(" ("), F.nullif(s["location"], F.lit("")), F.lit(")")), F.lit(""))))
        hidden = F.filter(segments, lambda s: s["kind"].isin(*HIDDEN_KINDS))
        h4 = F.transform(hidden, lambda s: F.when(s["kind"] == "docx_hidden", F.concat(place(s, "unknown"), F.lit(": DOCX concealment: "), F.coalesce(s["concealment"], F.lit("unknown")))).otherwise(F.concat(place(s, "unknown"), F.lit(": "), F.substring(strip(s["text"]), 1, 80))))
        h5 = F.transform(F.filter(segments, _meaningful(out_of_band)), lambda s: F.concat(F.lit("["), s["kind"], F.lit("] "), place(s, ""), F.lit(": "), F.substring(strip(s["text"]), 1, 120)))
    h2 = F.when(zero_width > 0, h2).otherwise(none)
    h3 = F.when(bidi, F.array(F.lit("bidi control characters present"))).otherwise(none)
    h6 = F.transform(mixed_tokens(text, mixed), lambda t: F.concat(F.lit("token: "), quoted(t)))
    h7 = F.transform(invisible_runs(text, payload, runs), lambda r: F.concat(r["size"].cast("string"), F.lit(" contiguous invisible chars at offset "), r["start"].cast("string"), F.lit(" -> "), decode_payload(r["run"])))
    return F.struct(F.array(F.lit("parsed successfully")).alias("h1"), *(or_none(x).alias(f"h{i}") for i, x in enumerate((h2, h3, h4, h5, h6, h7), 2)))


def _unless_refused(found: Column, status: Column | None) -> Column:
    empty = F.array().cast("array<string>")
    return found if status is None else F.when(status == "ok", found).otherwise(F.struct(F.array(status).alias("h1"), *(empty.alias(f"h{i}") for i in range(2, 8))))


def evidence(segments: Column, status: Column | None = None, payload: int = 16, out_of_band: int = 10) -> Column:
    """``_evidence`` as one expression of the segments."""
    text = body_text(segments)
    return _unless_refused(_evidence(text, segments, zero_width_count(text), has_bidi(text), has_mixed_script(text), has_payload(text, payload), payload, out_of_band), status)


def observed(rows: DataFrame, segments: str | None = None, text: str | None = None, status: str | None = None, with_evidence: bool = False, density: float = 0.01, payload: int = 16, out_of_band: int = 10) -> DataFrame:
    """rows with o (``observe``) and, if asked for, e (``evidence``), of a column of segments or of one of plain texts.

    The body text and each test are columns, computed once for mask and evidence; texts of ASCII alone are not searched.
    """
    own, say = F.col("__text"), F.lit(True) if status is None else F.col(status) == "ok"
    plain = F.coalesce(only_ascii(own), F.lit(True))
    made = rows.withColumn("__text", F.col(text) if segments is None else body_text(F.col(segments)))
    made = made.withColumns({
        "__zero_width": F.when(plain, 0).otherwise(zero_width_count(own)),
        "__bidi": ~plain & has_bidi(own),
        "__mixed": ~plain & has_mixed_script(own),
        "__runs": ~plain & has_payload(own, payload),
    })
    dense = F.coalesce(F.try_divide(F.col("__zero_width").cast("double"), F.length(own).cast("double")), F.lit(0.0)) >= density
    hidden, said = (F.lit(False), F.lit(False)) if segments is None else (_hidden(F.col(segments)), F.exists(segments, _meaningful(out_of_band)))
    found = [_struct(say, [dense, F.col("__bidi"), hidden, said, F.col("__mixed"), F.col("__runs")]).alias("o")]
    if with_evidence:
        lines = _evidence(own, None if segments is None else F.col(segments), F.col("__zero_width"), F.col("__bidi"), F.col("__mixed"), F.col("__runs"), payload, out_of_band)
        found.append(_unless_refused(lines, None if status is None else F.col(status)).alias("e"))
    return made.select(*rows.columns, *found)


def diagnostics(text: Column, encoding: Column | None = None, counts: Column | None = None, status: Column | None = None, density: float = 0.01, payload: int = 16, out_of_band: int = 10, places: int | None = 4) -> Column:
    """A JSON text: the density to four places (half to even; as it is if ``places`` is None), the thresholds, the version,
    and where there are any the encoding's name and the file's counts, by name; of a refused file the version alone."""
    own = zero_width_density(text) if places is None else F.bround(zero_width_density(text), places)
    some = F.lit(None).cast("map<string,bigint>") if counts is None else counts
    numbers = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(F.lit(', "'), k, F.lit('": '), m[k].cast("string"))), "")
    plain = F.to_json(F.struct(own.alias("zero_width_density"), F.lit(density).alias("zero_width_threshold"), F.lit(payload).alias("payload_min_length"), F.lit(out_of_band).alias("oob_min_length"), F.lit(VERSION).alias("version")))
    named = F.lit("") if encoding is None else F.coalesce(F.concat(F.lit(', "encoding_name": "'), encoding, F.lit('"')), F.lit(""))
    found = F.concat(F.regexp_replace(plain, r"\}$", ""), named, F.coalesce(numbers(some), F.lit("")), F.lit("}"))
    return found if status is None else F.when(status == "ok", found).otherwise(F.to_json(F.struct(F.lit(VERSION).alias("version"))))
