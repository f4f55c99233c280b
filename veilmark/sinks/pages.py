"""Rows of observed documents in pages of fixed size, in the order of their sources, however many there are.

Rows are sorted by range over their sources, so that no task and no page has more than its share; a row's number, and with it
its page, comes from the ranges' offsets.  A page is made where its rows are, by a function from rows to a body, and written
as a file.  The driver holds the totals and one number for each range.
"""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import language
from veilmark.operators import report, summary
from veilmark.sinks import files

ROWS = 1000


def rows(observed: DataFrame, base: str | None = None, most: int = 2, longest: int = 120) -> DataFrame:
    """source, path, mask, bits, class, evidence of observed documents (source, o, e): what a report's table shows."""
    bits = F.array(*(F.col("o")[h].cast("boolean") for h in summary.HYPOTHESES))
    return observed.select("source", report.display_path(F.col("source"), base).alias("path"), F.col("o.mask").alias("mask"), bits.alias("bits"), summary.row_class(F.col("o")).alias("class"), summary.evidence_line(F.col("e"), most, longest).alias("evidence"))


def paged(table: DataFrame, size: int = ROWS, staged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """page (from 1) and rows (an array, in order) of a table sorted by source.

    ``staged`` writes a table and reads it again, so that the sort is not done twice; by default it is cached.
    """
    ordered = table.orderBy("source").withColumn("__id", F.monotonically_increasing_id())
    ordered = staged(ordered) if staged else ordered.persist()
    place = ordered.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)})
    ranges = place.groupBy("__range").agg((F.max("__at") + 1).alias("__n"))  # a row for each task of the sort
    before = ranges.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    number = place.join(F.broadcast(before), "__range").withColumn("__number", F.col("__before") + F.col("__at"))
    page = (F.floor(F.col("__number") / size) + 1).cast("long")
    return number.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("__number", *table.columns))).alias("rows"))


def _cell(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_STYLE = "<style>body{font-family:sans-serif}table{border-collapse:collapse}td,th{padding:.3rem .6rem;border-bottom:1px solid #ddd;text-align:left}.flagged{background:#fff5f5}.unparsed{color:#777}.on{background:#d73a49;color:#fff}.off{color:#999}th{cursor:pointer}</style>"
_SORT = "<script>var turn={};document.querySelectorAll('#rows th').forEach((h,i)=>h.onclick=()=>{var b=document.querySelector('#rows tbody');turn[i]=-(turn[i]||-1);[...b.rows].sort((x,y)=>turn[i]*x.cells[i].textContent.localeCompare(y.cells[i].textContent)).forEach(r=>b.append(r))})</script>"
_GO = "<script>function go(n){n=parseInt(n,10);if(n>=1&&n<=%d)location='pages/'+String(n).padStart(9,'0')+'.html'}</script>"


def _name(page: Column) -> Column:
    return F.concat(F.lit("pages/"), F.lpad(page.cast("string"), 9, "0"), F.lit(".html"))


def page_html(pages: DataFrame, count: int, lang: str = "en") -> DataFrame:
    """name and body of each page of the table, with links to its neighbours."""
    heads = "".join(f"<th>{html.escape(c)}</th>" for c in ("path", "mask", "H1 – H7", "evidence"))
    badge = lambda b, i: F.concat(F.lit('<span class="'), F.when(b, "on").otherwise("off"), F.lit('">H'), (i + 1).cast("string"), F.lit("</span> "))
    line = lambda r: F.concat(F.lit('<tr class="'), r["class"], F.lit('"><td title="'), _cell(r["source"]), F.lit('">'), _cell(r["path"]), F.lit("</td><td>"), r["mask"], F.lit("</td><td>"), F.array_join(F.transform(r["bits"], badge), ""), F.lit("</td><td>"), _cell(F.coalesce(r["evidence"], F.lit(""))), F.lit("</td></tr>\n"))
    link = lambda n, said: F.concat(F.lit('<a href="'), F.lpad(n.cast("string"), 9, "0"), F.lit(f'.html">{said}</a> '))
    page = F.col("page")
    ways = F.concat(F.lit('<a href="../index.html">&uarr;</a> '), F.when(page > 1, link(page - 1, "&larr;")).otherwise(""), page.cast("string"), F.lit(f" / {count} "), F.when(page < count, link(page + 1, "&rarr;")).otherwise(""))
    head = f'<!DOCTYPE html><html lang="{language.resolve(lang)}"><head><meta charset="utf-8"><title>Documents</title>{_STYLE}</head><body><p>'
    body = F.concat(F.lit(head), ways, F.lit(f'</p><table id="rows"><thead><tr>{heads}</tr></thead><tbody>\n'), F.array_join(F.transform("rows", line), ""), F.lit(f"</tbody></table>{_SORT}</body></html>\n"))
    return pages.select(_name(page).alias("name"), body.alias("body"))


def dashboard(observed: DataFrame, folder: str, base: str | None = None, lang: str = "en", size: int = ROWS, staged: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """A folder with ``index.html``, the corpus in numbers, and all rows in ``pages/``; the number of pages."""
    total = observed.count()
    count = -(-total // size)
    table = paged(rows(observed, base), size, staged)
    start = report.dashboard(summary.totals(observed), summary.mask_counts(observed), summary.hypothesis_counts(observed), summary.extension_counts(observed), lang)
    go = f'<p><a href="pages/000000001.html">1</a> &hellip; <a href="pages/{count:09}.html">{count}</a> <input size="9" onchange="go(this.value)"></p>{_GO % count}' if count else ""
    index = observed.sparkSession.createDataFrame([("index.html", start.replace("</body>", go + "</body>"))], "name string, body string")
    files.write(page_html(table, count, lang).unionByName(index), folder)
    return count
