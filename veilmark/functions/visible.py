"""Visible text, counted stripping, folding and marker rendering."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import chars, detect

_FLAG = rf"\x{{{chars.FLAG:X}}}"
_TAG = chars.one_of(chars.TAG)


def _checked(kinds: Iterable[str]) -> list[str]:
    unknown = set(kinds) - set(chars.STRIP_KINDS)
    if unknown:
        raise ValueError(f"unknown strip kinds {sorted(unknown)}; known ones are {sorted(chars.STRIP_KINDS)}")
    return [k for k in chars.STRIP_KINDS if k in set(kinds)]


def stripped(text: Column, kinds: Iterable[str] = tuple(chars.STRIP_KINDS)) -> Column:
    """text without the characters of these kinds; tag characters right after a black flag stay, as part of it."""
    for kind in _checked(kinds):
        if kind == "tag_chars":
            text = F.regexp_replace(text, rf"({_FLAG}{_TAG}*)|{_TAG}", "$1")
        else:
            text = F.regexp_replace(text, chars.one_of(chars.STRIP_KINDS[kind]), "")
    return text


def strip_count(text: Column, kind: str) -> Column:
    """How many characters of a kind ``stripped`` removes."""
    (kind,) = _checked([kind])
    own = F.regexp_replace(text, rf"{_FLAG}{_TAG}*", "") if kind == "tag_chars" else text
    return F.regexp_count(own, F.lit(chars.one_of(chars.STRIP_KINDS[kind])))


def visible_text(segments: Column, kinds: Iterable[str] = ()) -> Column:
    """Visible segments in order, joined by line feeds; those of only white space are dropped before stripping."""
    kinds = _checked(kinds)
    shown = F.filter(segments, lambda s: s["visible"] & (F.length(detect.strip(s["text"])) > 0))
    return F.array_join(F.transform(shown, lambda s: stripped(s["text"], kinds)), "\n")


def fold(text: Column, dashes: bool = False) -> Column:
    """Look-alikes, full-width ASCII and spaces to their counterparts; invisible characters deleted."""
    source, target = chars.fold_pairs(dashes)
    return F.translate(text, source, target)


def _marked(text: Column, mark) -> Column:  # noqa: ANN001
    special = chars.one_of(chars.INVISIBLE, chars.CONTROL)
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike(special), F.array_join(F.transform(each, lambda c: F.when(c.rlike(special), mark(c)).otherwise(c)), "")).otherwise(text)


def _point(c: Column) -> Column:
    return F.concat(F.lit("U+"), F.format_string("%04X", F.ascii(c)))


def markers(text: Column) -> Column:
    """Invisible characters as [U+XXXX]."""
    return _marked(text, lambda c: F.concat(F.lit("["), _point(c), F.lit("]")))


def markers_html(text: Column) -> Column:
    """HTML with invisible characters as marked spans."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    name = lambda c: F.when(c.rlike(chars.one_of(chars.ZERO_WIDTH)), "zw").when(c.rlike(chars.one_of(chars.BIDI)), "bidi").when(c.rlike(_TAG), "tag").when(c.rlike(chars.one_of(chars.VARIATION)), "vs").otherwise("ctrl")
    text = _marked(text, lambda c: F.concat(F.lit('<span class="inv '), name(c), F.lit('">'), _point(c), F.lit("</span>")))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("\t"), F.lit("&nbsp;" * 4))
