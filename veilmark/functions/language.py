"""Report language: a heuristic on characters, and the report's words in each language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import chars

DEFAULT = "en"
#: What reports call the observations.
LABELS = {
    "en": {"H1": "Parseable", "H2": "Zero-width density", "H3": "Bidi controls", "H4": "Format concealment", "H5": "Out-of-band text", "H6": "Mixed scripts", "H7": "Invisible payload"},
    "ja": {"H1": "解析可能", "H2": "ゼロ幅密度", "H3": "双方向制御", "H4": "書式による隠蔽", "H5": "帯域外テキスト", "H6": "文字種混在", "H7": "不可視ペイロード"},
}


def counts(text: Column) -> tuple[Column, Column]:
    return F.regexp_count(text, F.lit(chars.one_of(chars.JAPANESE))), F.regexp_count(text, F.lit("[A-Za-z]"))


def decide(japanese: Column, latin: Column) -> Column:
    """Japanese from four of its characters on, if they are at least half as many as Latin letters."""
    return F.when((japanese >= 4) & (japanese * 2 >= latin), "ja").otherwise(DEFAULT)


def resolve(language: str | None) -> str:
    short = (language or "").lower().replace("_", "-").split("-")[0]
    return short if short in LABELS else DEFAULT


def label(hypothesis: str, language: str | None = None) -> str:
    return LABELS[resolve(language)].get(hypothesis, hypothesis)


def supported() -> list[str]:
    return sorted(LABELS)
