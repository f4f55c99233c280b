"""Geometry lane: style declarations that make text too small, too faint or too flat to see.

Pages are parsed once, to a table of declarations (``css.declarations``); linked sheets are parsed as files of their own and
joined by path.  The rules themselves are built-in expressions over that table.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import contract
from veilmark.functions.detect import strip
from veilmark.sources import css

#: The default thresholds.
THRESHOLDS = {"font_size_px_max": 0.5, "opacity_max": 0.01, "scale_max": 0.01, "line_height_max": 0.0, "pdf_font_size_pt_max": 0.5}
BOUNDS = {"font_size_px_max": 10.0, "opacity_max": 1.0, "scale_max": 1.0, "line_height_max": 1.0, "pdf_font_size_pt_max": 10.0}
LENGTH = r"^\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z%]*)\s*$"
SCALE = r"(?i)(?:scale[xyz]?|scale3d)\s*\([^)]*\)"


def checked(thresholds: dict[str, float]) -> dict[str, float]:
    """All five thresholds, each within its bounds."""
    if set(thresholds) != set(THRESHOLDS):
        raise ValueError(f"thresholds must be exactly {sorted(THRESHOLDS)}")
    for key, value in thresholds.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= BOUNDS[key]:
            raise ValueError(f"{key} must be a number from 0 to {BOUNDS[key]}")
    return dict(thresholds)


#: The shape of a thresholds document.
SCHEMA = {
    "type": "object",
    "keys": {
        **{k: {"type": "string", "required": False} for k in ("version", "lane", "description")},
        "thresholds": {"type": "object", "keys": {k: {"type": "number", "min": 0, "max": most} for k, most in BOUNDS.items()}},
    },
}


@dataclass(frozen=True)
class Thresholds:
    values: dict[str, float]
    source: str

    @property
    def sha256(self) -> str:
        """Of the values alone, wherever they come from."""
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def load(text: str | bytes | None = None, source: str = "embedded") -> Thresholds:
    """The thresholds of a JSON text, which must fit SCHEMA; the defaults if there is none, or it isn't JSON."""
    if text is not None:
        try:
            value = contract.parse_strict(text)
        except contract.ContractError:
            return Thresholds(dict(THRESHOLDS), "embedded")
        contract.validate(value, SCHEMA)
        return Thresholds({k: float(value["thresholds"][k]) for k in THRESHOLDS}, source)
    return Thresholds(dict(THRESHOLDS), "embedded")


def declarations(style: Column) -> Column:
    """array<struct<name, value>> of an inline style."""
    parts = F.filter(F.split(style, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(strip(F.substring_index(p, ":", 1))).alias("name"), strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    return F.filter(pairs, lambda d: d["name"] != "")


def rules(name: Column, value: Column, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """array<struct<rule, matched, measured>> of one declaration."""
    number = F.expr("null").cast("double")
    number = F.when(value.rlike(LENGTH), F.regexp_extract(value, LENGTH, 1).try_cast("double"))
    unit = F.lower(F.regexp_extract(value, LENGTH, 2))
    none = F.array().cast("array<struct<rule:string,matched:string,measured:array<double>>>")
    one = lambda rule: F.array(F.struct(F.lit(rule).alias("rule"), value.alias("matched"), F.array(number).alias("measured")))
    small = lambda key: (number >= 0) & (number <= thresholds[key])

    def numbers(call: Column) -> Column:
        inner = F.regexp_extract(call, r"\(([^)]*)\)", 1)
        plain = F.filter(F.split(inner, ","), lambda a: a.rlike(r"^\s*[0-9]*\.?[0-9]+\s*$"))
        return F.transform(plain, lambda a: F.trim(a).try_cast("double"))

    calls = F.transform(F.regexp_extract_all(value, F.lit(SCALE), F.lit(0)), lambda c: F.struct(F.lit("scale_collapse").alias("rule"), c.alias("matched"), numbers(c).alias("measured")))
    flat = F.filter(calls, lambda c: F.exists(c["measured"], lambda n: (n >= 0) & (n <= thresholds["scale_max"])))
    return (
        F.when((name == "font-size") & unit.isin("", "px") & small("font_size_px_max"), one("font_size_tiny"))
        .when((name == "opacity") & (unit == "") & small("opacity_max"), one("opacity_near_zero"))
        .when((name == "line-height") & unit.isin("", "px") & small("line_height_max"), one("line_height_zero"))
        .when(name == "transform", flat)
        .otherwise(none)
    )


def inline(attributes: DataFrame, style: str = "style", thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """attributes (any columns and a style) with a row for each finding: property, rule, matched, measured."""
    each = attributes.select("*", F.explode(declarations(F.col(style))).alias("d"))
    found = each.select("*", F.explode(rules(F.col("d.name"), F.col("d.value"), thresholds)).alias("f"))
    return found.select(*attributes.columns, F.col("d.name").alias("property"), "f.rule", "f.matched", "f.measured")


def _place(row: str) -> Column:
    """Where a declaration stands, in words."""
    c = lambda name: F.col(f"{row}{name}").cast("string")
    sheet = F.concat(F.lit(", css line "), c("css_line"), F.lit(", selector: "), c("selector"))
    return (
        F.when(F.col(f"{row}origin") == "inline_style", F.concat(F.lit("line "), c("html_line"), F.lit(", <"), c("tag"), F.lit(">")))
        .when(F.col(f"{row}origin") == "style_block", F.concat(F.lit("inline <style> (html line "), c("html_line"), F.lit(")"), sheet))
        .otherwise(F.concat(F.lit("<link> "), F.element_at(F.split(c("path"), "/"), -1), sheet))
    )


LANE = "geometry"


def declared(pages: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """pages (source, content): source, part (0 inline, 1 own sheets, 2 linked ones), no, sub and css.DECLARED, with path; in order.

    Rows without a name stand for a sheet that was read, or (origin link) for one that was not found.
    """
    own = css.declarations(pages, "source")
    plain = own.filter("origin <> 'link'").withColumns({"part": F.when(F.col("origin") == "inline_style", 0).otherwise(1), "sub": F.lit(0), "path": F.lit(None).cast("string")})
    links = own.filter("origin = 'link'").withColumn("folder", F.regexp_replace("source", r"/[^/]*$", "")).withColumnRenamed("value", "href").drop("name", "selector", "css_line")
    if sheets is None:
        missing = links.withColumns({"path": F.lit(None).cast("string"), "found": F.lit(False)})
    else:
        paths = sheets.select("path", F.lit(True).alias("found")).distinct()
        missing = css.linked(links, paths).withColumn("found", F.coalesce("found", F.lit(False)))
    stands = missing.select("source", F.lit(2).alias("part"), "no", F.lit(-1).alias("sub"), F.when(F.col("found"), "linked_css").otherwise("link").alias("origin"), "tag", "id", "class", "html_line", F.lit(None).cast("string").alias("selector"), F.lit(None).cast("int").alias("css_line"), F.lit("").alias("name"), F.lit("").alias("value"), "path")
    every = [plain.select(*stands.columns), stands]
    if sheets is not None:
        inside = css.sheet_declarations(sheets).withColumnRenamed("no", "sub")
        every.append(missing.filter("found").drop("tag", "id", "class").join(inside, "path").select("source", F.lit(2).alias("part"), "no", "sub", F.lit("linked_css").alias("origin"), *(F.lit(None).cast("string").alias(c) for c in ("tag", "id", "class")), "html_line", "selector", "css_line", "name", "value", "path"))
    out = every[0]
    for other in every[1:]:
        out = out.unionByName(other)
    return out


def audit(table: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """``declared``'s rows with one for each finding: source, part, no, sub, nth, origin, location, tag, id, class, property, rule, value, matched, measured, threshold."""
    limit = F.create_map(*(F.lit(x) for r, k in (("font_size_tiny", "font_size_px_max"), ("opacity_near_zero", "opacity_max"), ("line_height_zero", "line_height_max"), ("scale_collapse", "scale_max")) for x in (r, float(thresholds[k]))))
    name = F.lower("name")
    found = table.filter(F.col("name") != "").select("*", F.posexplode(rules(name, F.col("value"), thresholds)).alias("nth", "f"))
    return found.select("source", "part", "no", "sub", "nth", "origin", _place("").alias("location"), "tag", "id", "class", name.alias("property"), "f.rule", "value", "f.matched", "f.measured", limit[F.col("f.rule")].alias("threshold"))


def scanned(table: DataFrame) -> DataFrame:
    """source, inline_declarations, style_blocks, linked_css_files, linked_css_unresolved: what was looked at in each page that has any."""
    stands = F.col("name") == ""
    count = lambda test, name: F.count_if(test).alias(name)
    return table.groupBy("source").agg(
        count((F.col("origin") == "inline_style"), "inline_declarations"), count((F.col("origin") == "style_block") & stands, "style_blocks"),
        count((F.col("origin") == "linked_css") & stands, "linked_css_files"), count((F.col("origin") == "link"), "linked_css_unresolved"),
    )


def receipt(findings: DataFrame, thresholds: Thresholds, sources: DataFrame | None = None, looked: DataFrame | None = None) -> DataFrame:
    """source, text, json: a page's findings in order, one line each, and as JSON.

    Of ``sources`` (source) each has a receipt, others than those with findings too; ``looked`` is ``scanned``'s table.
    """
    fields = ["origin", "location", "property", "rule", "value", "measured", "threshold"]
    rows = F.sort_array(F.collect_list(F.struct("part", "no", "sub", "nth", *fields)))
    each = findings.groupBy("source").agg(rows.alias("r"))
    if sources is not None:
        each = sources.select("source").distinct().join(each, "source", "left").select("source", F.coalesce("r", F.array().cast(each.schema["r"].dataType)).alias("r"))
    counts = F.lit(None).cast("struct<inline_declarations:bigint>")
    if looked is not None:
        names = [c for c in looked.columns if c != "source"]
        each = each.join(looked, "source", "left")
        counts = F.struct(*(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    line = lambda r: F.concat(F.lit("- "), r["rule"], F.lit(" @ "), r["location"], F.lit(": "), r["property"], F.lit(": "), r["value"])
    head = F.concat(F.lit("Geometry: "), F.col("source"), F.lit("\nthresholds "), F.lit(thresholds.sha256), F.lit(" ("), F.lit(thresholds.source), F.lit("), observations: "), F.size("r").cast("string"), F.lit("\n"))
    told = F.to_json(F.struct(
        F.lit(LANE).alias("lane"), F.col("source"), F.struct(*(F.lit(float(v)).alias(k) for k, v in thresholds.values.items())).alias("thresholds"), F.lit(thresholds.source).alias("thresholds_source"), F.lit(thresholds.sha256).alias("thresholds_sha256"),
        F.lit(True).alias("block_css_parsed"), counts.alias("scanned"), F.size("r").alias("observation_count"), F.transform("r", lambda r: F.struct(*(r[c].alias(c) for c in fields))).alias("observations"),
    ))
    return each.select("source", F.concat(head, F.array_join(F.transform("r", line), "\n"), F.lit("\n")).alias("text"), told.alias("json"))
