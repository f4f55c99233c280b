"""Control-syntax lane: phrases and tags that address a model, with exact offsets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import contract

#: Category, name, pattern, description.
VOCABULARY = (
    ("special_tokens", "openai_im_start", "<|im_start|>", "OpenAI chat template role start marker"),
    ("special_tokens", "openai_im_end", "<|im_end|>", "OpenAI chat template role end marker"),
    ("special_tokens", "llama_inst_start", "[INST]", "Llama chat template instruction start marker"),
    ("special_tokens", "llama_inst_end", "[/INST]", "Llama chat template instruction end marker"),
    ("special_tokens", "llama_sys", "<<SYS>>", "Llama 2 system prompt marker"),
    ("override_phrases_en", "ignore_previous", "Ignore all previous instructions", "Classic instruction reset phrase"),
    ("override_phrases_en", "disregard_above", "Disregard the text above", "Context override phrase"),
    ("override_phrases_en", "developer_mode", "You are now in developer mode", "Persona and mode hijacking phrase"),
    ("override_phrases_jp", "ignore_previous_jp", "これまでの指示をすべて無視", "Japanese instruction reset phrase"),
    ("override_phrases_jp", "priority_override_jp", "ここからの指示が最優先", "Japanese priority override phrase"),
    ("structural_tags", "system_instruction_tag", "[SYSTEM INSTRUCTION]", "Pseudo system command tag"),
    ("structural_tags", "override_tag", "[OVERRIDE]", "Pseudo override tag"),
    ("structural_tags", "markdown_instruction_header", "### Instruction:", "Markdown instruction block header"),
    ("structural_tags", "begin_system_override", "--- BEGIN SYSTEM OVERRIDE ---", "Pseudo system override fence"),
)
BACKING_KINDS = ("metadata",)
LANE = "control_syntax"
EXCERPT = 30
_PATTERN = {
    "type": "object",
    "keys": {
        **{k: {"type": "string", "min_len": 1} for k in ("category", "name", "pattern")},
        "match": {"type": "string", "enum": ["literal", "regex"], "required": False},
        "case_sensitive": {"type": "boolean", "required": False},
        "description": {"type": "string", "required": False},
    },
}


def _said(kinds: list[str]) -> None:
    if "" in kinds:
        raise ValueError("a backing kind must have a name")


SCHEMA = {
    "type": "object",
    "keys": {
        **{k: {"type": "string", "required": False} for k in ("version", "lane", "description")},
        "backing_kinds": {"type": "array", "item_type": "string", "required": False, "validator": _said},
        "patterns": {"type": "array", "item_schema": _PATTERN},
    },
}


@dataclass(frozen=True)
class Vocabulary:
    """Patterns (category, name, pattern, description, match, case_sensitive) and the kinds of segments that back them."""

    patterns: tuple[tuple[str, str, str, str, str, bool], ...]
    backing: tuple[str, ...]
    source: str

    @property
    def sha256(self) -> str:
        """Of the content alone: the same vocabulary has the same digest wherever it comes from."""
        names = ("category", "name", "pattern", "description", "match", "case_sensitive")
        content = {"backing_kinds": list(self.backing), "patterns": [dict(zip(names, p)) for p in self.patterns]}
        return hashlib.sha256(json.dumps(content, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p[0], p[1], p[2], p[4], p[5]) for i, p in enumerate(self.patterns)]
        return spark.createDataFrame(rows, "pattern_no int, category string, name string, pattern string, match string, case_sensitive boolean")


def vocabulary(text: str | bytes | None = None, source: str = "embedded") -> Vocabulary:
    """The vocabulary of a JSON text, which must fit SCHEMA; the built-in one if there is none, or it isn't JSON.

    One of the wrong shape, or with a pattern that is no regular expression where it says so, raises ContractError.
    """
    if text is not None:
        try:
            value = contract.parse_strict(text)
        except contract.ContractError:
            value = None
        if value is not None:
            contract.validate(value, SCHEMA)
            for at, p in enumerate(value["patterns"]):
                if p.get("match") == "regex":
                    try:
                        re.compile(p["pattern"])
                    except re.error as e:
                        raise contract.ContractError(f"/patterns/{at}/pattern", f"not a regular expression: {e}") from e
            patterns = tuple((p["category"], p["name"], p["pattern"], p.get("description", ""), p.get("match", "literal"), p.get("case_sensitive", False)) for p in value["patterns"])
            return Vocabulary(patterns, tuple(value.get("backing_kinds", BACKING_KINDS)), source)
    return Vocabulary(tuple((*row, "literal", False) for row in VOCABULARY), BACKING_KINDS, "embedded")


def load(spark: SparkSession, source: str | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """(table of patterns, backing kinds) of ``vocabulary(source)``."""
    found = vocabulary(source)
    return found.table(spark), found.backing


class Literals:
    """All literal patterns as two automata, of text and of lower-case text, so that one pass finds any number of them."""

    def __init__(self, patterns: list[tuple[str, bool]]) -> None:
        self.sizes = [len(p) for p, _ in patterns]
        self.automata = []
        for exact in (True, False):
            numbers: dict[str, list[int]] = {}
            for i, (pattern, case_sensitive) in enumerate(patterns):
                if pattern and case_sensitive == exact:
                    numbers.setdefault(pattern if exact else pattern.lower(), []).append(i)
            automaton = ahocorasick.Automaton()
            for key, own in numbers.items():
                automaton.add_word(key, (len(key), own))
            if numbers:
                automaton.make_automaton()
            self.automata.append(automaton if numbers else None)

    def find(self, text: str) -> list[tuple[int, int]]:
        """(number of the pattern, start) of each pattern's occurrences that don't overlap, from the left."""
        out: list[tuple[int, int]] = []
        for automaton, searched in zip(self.automata, (text, text.lower() if self.automata[1] else "")):
            free: dict[int, int] = {}
            for last, (size, own) in automaton.iter(searched) if automaton and searched else ():
                start = last + 1 - size
                for i in own:
                    if start >= free.get(i, 0):
                        out.append((i, start))
                        free[i] = last + 1
        return out


def _matched(segments: DataFrame, patterns: list[tuple]) -> DataFrame:
    """segments with a row for each match; patterns are (number, category, name, pattern, match, case_sensitive)."""
    names = segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literal = [p for p in patterns if p[4] == "literal"]
        literals = Literals([(p[3], p[5]) for p in literal])
        compiled = [(*p[:4], re.compile(p[3], 0 if p[5] else re.IGNORECASE)) for p in patterns if p[4] == "regex"]
        for batch in batches:
            hits: list[tuple] = []
            for i, value in enumerate(batch.column(names.index("text"))):
                text = value.as_py() or ""
                hits += [(i, *literal[k][:4], start, literals.sizes[k]) for k, start in literals.find(text)]
                hits += [(i, *e[:4], m.start(), m.end() - m.start()) for e in compiled for m in e[4].finditer(text)]
            at, number, category, name, pattern, start, size = zip(*hits) if hits else ((),) * 7
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(number, pa.int32()), pa.array(category, pa.string()), pa.array(name, pa.string()), pa.array(pattern, pa.string()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], [*names, "pattern_no", "category", "name", "pattern", "offset", "matched"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInArrow(run, schema + ", pattern_no int, category string, name string, pattern string, offset int, matched int")


def scan(segments: DataFrame, vocabulary: DataFrame, backing: tuple[str, ...] = BACKING_KINDS) -> DataFrame:
    """segments (doc_id, seg_no, kind, location, text) with a row for each hit: category, name, offset, backed, excerpt.

    The order of a document's hits is that of seg_no, offset and pattern_no.

    The vocabulary is configuration, read by the driver and sent to all tasks.  Texts are read once: literal patterns, any
    number of them, by an automaton, regular expressions (Python's) one after the other.
    """
    patterns = [tuple(r) for r in vocabulary.select("pattern_no", "category", "name", "pattern", "match", "case_sensitive").orderBy("pattern_no").collect()]
    hits = _matched(segments, patterns)
    low = F.greatest(F.lit(0), F.col("offset") - EXCERPT)
    size = F.col("offset") + F.col("matched") + EXCERPT - low
    return hits.select("doc_id", "seg_no", "kind", "location", "pattern_no", "category", "name", "pattern", "offset", F.col("kind").isin(*backing).alias("backed"), F.translate(F.substring("text", low + 1, size), "\r\n\t", "   ").alias("excerpt"))


def receipt(hits: DataFrame, used: Vocabulary, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, text, json, n_backed: a document's hits outside backing zones in order, and the number of those inside.

    Of ``documents`` (doc_id) each has a receipt, others than those with hits too.
    """
    fields = ["category", "name", "pattern", "kind", "location", "offset", "excerpt"]
    found = F.filter(F.sort_array(F.collect_list(F.struct("seg_no", "offset", "pattern_no", "backed", *(c for c in fields if c != "offset")))), lambda h: ~h["backed"])
    each = hits.groupBy("doc_id").agg(found.alias("h"), F.count_if("backed").alias("n_backed"))
    if documents is not None:
        each = documents.select("doc_id").distinct().join(each, "doc_id", "left").select("doc_id", F.coalesce("h", F.array().cast(each.schema["h"].dataType)).alias("h"), F.coalesce("n_backed", F.lit(0)).alias("n_backed"))
    line = lambda h: F.concat(F.lit("- ["), h["category"], F.lit("] "), h["name"], F.lit(" @ "), F.coalesce(h["location"], h["kind"]), F.lit(", offset "), h["offset"].cast("string"), F.lit(": "), h["excerpt"])
    source = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("Control syntax: "), source, F.lit(f"\nvocabulary {used.sha256} ("), F.lit(used.source), F.lit(f"), {len(used.patterns)} patterns, backing zones: {', '.join(used.backing) or '(none)'}\nin backing zones: "),
        F.col("n_backed").cast("string"), F.lit("\nfindings: "), F.size("h").cast("string"), F.lit("\n"),
    )
    finding = lambda h: F.struct(
        F.lit(LANE).alias("lane"), F.lit("pattern_found").alias("observation"), h["category"].alias("category"), h["name"].alias("name"), h["pattern"].alias("pattern"), h["kind"].alias("segment_kind"),
        F.coalesce(h["location"], F.lit("")).alias("location"), h["offset"].alias("offset"), F.lit("absent").alias("backing"), h["excerpt"].alias("excerpt"),
    )
    told = F.to_json(F.struct(
        F.lit(LANE).alias("lane"), source.alias("source"), F.array(*map(F.lit, used.backing)).cast("array<string>").alias("backing_kinds"), F.lit(used.source).alias("vocab_source"), F.lit(used.sha256).alias("vocab_sha256"),
        F.lit(len(used.patterns)).alias("pattern_count"), F.col("n_backed").alias("backed_count"), F.size("h").alias("finding_count"), F.transform("h", finding).alias("findings"),
    ))
    return each.select("doc_id", F.concat(head, F.array_join(F.transform("h", line), "\n"), F.when(F.size("h") > 0, "\n").otherwise("")).alias("text"), told.alias("json"), "n_backed")
