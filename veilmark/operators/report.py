"""Receipts and reports of observations, as text, JSON and HTML."""

from __future__ import annotations

import html
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import detect, language, visible
from veilmark.operators.summary import HYPOTHESES

RULE = 66


def text_report(source: Column, observed: Column, evidence: Column, lang: str = "en") -> Column:
    """One document's report: states, then evidence, then what it does not say."""
    names = {h: language.label(h.upper(), lang) for h in HYPOTHESES}
    thick, thin = F.lit("=" * RULE), F.lit("-" * RULE)
    lines = [thick, F.lit("  OBSERVATION REPORT"), F.lit(f"  Version : {detect.VERSION}"), F.concat(F.lit("  Source  : "), source), F.concat(F.lit("  Mask    : "), observed["mask"]), thick, F.lit("")]
    lines += [F.concat(F.lit(f"[{h.upper()}] {names[h]:<22} "), F.when(observed[h] == 1, "DETECTED").otherwise("not detected")) for h in HYPOTHESES]
    lines += [F.lit(""), thin, F.lit("  EVIDENCE"), thin]
    for h in HYPOTHESES:
        lines.append(F.concat(F.lit(f"[{h.upper()}] {names[h]}\n"), F.array_join(F.transform(evidence[h], lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), "")))
    lines += [thin, F.lit("  NOTE\n  An observation, not a judgment of intent; a person must decide what it means."), thick]
    return F.concat_ws("\n", *lines)


_STYLE = (
    "<style>body{font-family:sans-serif;max-width:60rem;margin:2rem auto}table{border-collapse:collapse}td,th{text-align:left;padding:.3rem .6rem;border-bottom:1px solid #ddd}.mask{font-family:monospace;font-size:1.5rem}"
    ".on{color:#d73a49;font-weight:bold}.off{color:#777}.inv{background:#fdd;font-size:.75em}.inv.bidi{background:#dde6ff}.inv.tag{background:#dfd}.inv.vs{background:#fed}.inv.ctrl{background:#eee}</style>"
)


def html_report(source: Column, observed: Column, evidence: Column, segments: Column, lang: str = "en") -> Column:
    """One document's report as a page of its own: mask, states, evidence, and segments with what can't be seen marked."""
    digit = lambda c: F.when(c == "1", '<span class="on">1</span>').when(c == "0", '<span class="off">0</span>').otherwise("&ndash;")
    mask = F.concat(F.lit('<p class="mask" data-mask="'), observed["mask"], F.lit('">'), F.array_join(F.transform(F.split(observed["mask"], ""), digit), ""), F.lit("</p>"))
    names = {h: html.escape(language.label(h.upper(), lang)) for h in HYPOTHESES}
    states = [F.concat(F.lit(f"<tr><td>{h.upper()}</td><td>{names[h]}</td><td class="), F.when(observed[h] == 1, '"on">DETECTED').otherwise('"off">not detected'), F.lit("</td></tr>")) for h in HYPOTHESES]
    lines = [F.concat(F.lit(f"<h2>[{h.upper()}] {names[h]}</h2><ul>"), F.array_join(F.transform(evidence[h], lambda x: F.concat(F.lit("<li>"), visible.markers_html(x), F.lit("</li>"))), ""), F.when(F.size(evidence[h]) == 0, "<li>(no evidence)</li>").otherwise(""), F.lit("</ul>")) for h in HYPOTHESES]
    rows = F.transform(segments, lambda s: F.concat(F.lit("<tr><td>"), s["kind"], F.lit("</td><td>"), visible.markers_html(F.coalesce(s["location"], F.lit(""))), F.lit("</td><td>"), visible.markers_html(s["text"]), F.lit("</td></tr>")))
    head = f'<!DOCTYPE html><html lang="{language.resolve(lang)}"><head><meta charset="utf-8"><title>Observation</title>{_STYLE}</head><body><h1>'
    foot = f"</table><footer><p>An observation, not a judgment of intent; a person must decide what it means.</p><p>Version {detect.VERSION}; no times, chance or outside resources are in this page.</p></footer></body></html>\n"
    shown = F.coalesce(F.array_join(rows, ""), F.lit(""))  # a file that could not be read has no segments
    return F.concat(F.lit(head), visible.markers_html(source), F.lit("</h1>"), mask, F.lit("<table>"), *states, F.lit("</table>"), *lines, F.lit("<table>"), shown, F.lit(foot))


def receipt(value: Any) -> str:
    """JSON as receipts hold it: indented, not escaped, ended by a line feed."""
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def json_receipt(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def display_path(source: Column, base: str | None = None) -> Column:
    """source below the folder ``base``, or just its name where it lies elsewhere; as it is if there is no base."""
    if base is None:
        return source
    inside = base.rstrip("/") + "/"
    return F.when(F.startswith(source, F.lit(inside)), F.substring(source, len(inside) + 1, 1 << 30)).otherwise(F.element_at(F.split(source, "/"), -1))


def sample_language(rows: DataFrame, lang: str = "auto", documents: int = 5, each: int = 5) -> str:
    """The language of a report: the given one, or what the paths and first segments of the first documents suggest."""
    if lang != "auto":
        return language.resolve(lang)
    first = rows.orderBy("source").limit(documents).select("source", F.array_join(F.transform(F.slice("segments", 1, each), lambda s: s["text"]), " ").alias("said"))
    japanese, latin = language.counts(F.concat_ws(" ", "source", "said"))
    found = first.agg(language.decide(F.coalesce(F.sum(japanese), F.lit(0)), F.coalesce(F.sum(latin), F.lit(0)))).first()[0]
    return language.resolve(found)


def dashboard(totals: DataFrame, masks: DataFrame, hypotheses: DataFrame, extensions: DataFrame, lang: str = "en") -> str:
    """A page of the corpus summaries, with bars; what reaches the driver is of bounded size but for the extensions that occur.

    ``sinks.pages`` puts all rows beside it.
    """
    t = totals.first().asDict()

    def bars(title: str, rows: list[tuple[str, int]]) -> str:
        most = max((n for _, n in rows), default=1) or 1
        cells = "".join(f'<tr><td>{html.escape(k)}</td><td><div style="background:#69c;width:{round(200 * n / most)}px">&nbsp;</div></td><td>{n}</td></tr>' for k, n in rows)
        return f"<h2>{html.escape(title)}</h2><table>{cells}</table>"

    parts = [
        "<table>" + "".join(f"<tr><td>{html.escape(k)}</td><td>{v}</td></tr>" for k, v in t.items()) + "</table>",
        bars("Masks", sorted((r.mask, r.documents) for r in masks.collect())),
        bars("Observations", sorted((f"{r.hypothesis} {language.label(r.hypothesis, lang)}", r.documents) for r in hypotheses.collect())),
        bars("Extensions", sorted((r.extension, r.documents) for r in extensions.collect())),
    ]
    return f'<!DOCTYPE html><html lang="{language.resolve(lang)}"><head><meta charset="utf-8"><title>Corpus</title></head><body>{"".join(parts)}</body></html>\n'
