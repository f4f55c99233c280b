"""Style sheets: rules and declarations, which of them hide, and which elements a selector matches.

Two readers of pages are here beside the plain one of ``html``: ``html_css`` reports every rule that hides, whether or
not something fits it, and ``html_css_full`` those that fit an element, from a tree of the page.  Sheets that a page
links are files of their own: ``extract`` joins them by path, and reads no file from within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions.detect import SEGMENT
from veilmark.sources import reading
from veilmark.sources.html import CODE, LEAST, VOID, Event, events, segments, spoken
from veilmark.sources.reading import Limits, Segment, decode

#: Declarations that hide what they apply to.
HIDING = {
    "display": r"none", "visibility": r"hidden", "opacity": r"0(?:\.0+)?", "font-size": r"0(?:px|pt|em|rem|%)?", "text-indent": r"-\d{3,}(?:px|em|rem|%)?",
    "clip": r"rect\(\s*0[,\s]+0[,\s]+0[,\s]+0\s*\)", "clip-path": r"inset\(\s*100%\s*\)", **dict.fromkeys(("left", "top", "right", "bottom"), r"-\d{4,}(?:px|em|rem|%)?"),
}
#: Tags that are no part of what a page shows.
OUTSIDE = CODE | {"link"}


def hides(name: str, value: str) -> bool:
    pattern = HIDING.get(name.strip().lower())
    return bool(pattern and re.fullmatch(pattern, value.strip(), re.IGNORECASE))


def style_hides(style: str) -> bool:
    return any(hides(name, value) for name, colon, value in (d.partition(":") for d in style.split(";")) if colon)


@dataclass(frozen=True)
class Declaration:
    name: str
    value: str
    line: int
    important: bool = False


@dataclass(frozen=True)
class Rule:
    selector: str
    line: int
    declarations: list[Declaration]

    def hiding(self, important: bool = True) -> Declaration | None:
        """The first declaration that hides."""
        return next((d for d in self.declarations if hides(d.name, d.value) and (important or not d.important)), None)


_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|<!--|-->|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|\\.|[{}()\[\];]""", re.DOTALL)
_CLOSES = {"}": "{", ")": "(", "]": "["}
_DECLARED = re.compile(r"\s*(--[\w-]*|-?[A-Za-z_\u0080-\uffff\\][\w\\\u0080-\uffff-]*)\s*:(.*)", re.DOTALL)


def _cut(text: str, low: int, high: int, ends: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, what ended it) of the stretches that ``ends`` part outside brackets; a block ends at its brace."""
    start, open_ = low, []
    for m in _TOKEN.finditer(text, low, high):
        token = m[0]
        if token in "([{":
            open_.append(token)
        elif token in _CLOSES:
            if open_ and open_[-1] == _CLOSES[token]:
                open_.pop()
                if not open_ and token in ends:
                    yield start, m.end(), token
                    start = m.end()
        elif token == ";" and not open_ and (";" in ends or text[start : m.start()].lstrip().startswith("@")):
            yield start, m.start(), token
            start = m.end()
    if start < high:
        yield start, high, ""


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _declared(sheet: str, low: int, high: int) -> Iterator[Declaration]:
    for start, end, _ in _cut(sheet, low, high, ";"):
        m = _DECLARED.fullmatch(sheet, start, end)
        if m:
            value = m[2].strip()
            important = re.search(r"!\s*important$", value, re.IGNORECASE)
            yield Declaration(m[1], value[: important.start()].strip() if important else value, _line(sheet, m.start(1)), bool(important))


def rules(sheet: str) -> Iterator[Rule]:
    """Top-level rules; what stands in @-rules is left out."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", lambda m: re.sub(r"[^\n]", " ", m[0]), sheet.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n"), flags=re.DOTALL)
    for start, end, ended in _cut(sheet, 0, len(sheet), "}"):
        brace = next((m.start() for m in _TOKEN.finditer(sheet, start, end) if m[0] == "{"), None)
        prelude = sheet[start:brace] if brace is not None else ""
        if ended == ";" or not prelude.strip() or prelude.lstrip().startswith("@"):
            continue
        line = _line(sheet, start + len(prelude) - len(prelude.lstrip()))
        yield Rule(prelude.strip(), line, list(_declared(sheet, brace + 1, end - (ended == "}"))))


@dataclass
class Element:
    tag: str
    own: dict[str, str]
    line: int = 0
    parent: Element | None = None
    children: list[Element] = field(default_factory=list)
    text: str = ""


@dataclass
class Page:
    """A page's elements below its root; its sheets, as (line of the tag, text), and linked ones, as (line, href)."""

    root: Element
    sheets: list[tuple[int, str]]
    links: list[tuple[int, str]]
    comments: list[tuple[int, str]]


def page(seen: list[Event]) -> Page:
    """A page from its events; each element's text is all that stands in it directly."""
    made = Page(Element("#document", {}), [], [], [])
    at, mode = made.root, ""
    for e in seen:
        if e.kind == "open" and e.value in CODE:
            mode = e.value
            if mode == "style":
                made.sheets.append((e.line, ""))
        elif e.kind == "close" and e.value in CODE:
            mode = ""
        elif e.kind == "open" and e.value == "link":
            if "stylesheet" in e.attributes.get("rel", "").lower() and e.attributes.get("href"):
                made.links.append((e.line, e.attributes["href"]))
        elif e.kind == "open":
            child = Element(e.value, e.attributes, e.line, at)
            at.children.append(child)
            at = at if e.value in VOID else child
        elif e.kind == "close":
            found = next((x for x in _upwards(at) if x.tag == e.value), None)
            at = found.parent if found is not None else at
        elif e.kind == "text" and mode == "style":
            line, text = made.sheets.pop()
            made.sheets.append((line, text + e.value))
        elif e.kind == "text" and not mode:
            at.text += e.value
        elif e.kind == "comment":
            made.comments.append((e.line, e.value.strip()))
    return made


def _upwards(e: Element) -> Iterator[Element]:
    while e.parent is not None:
        yield e
        e = e.parent


def everything(root: Element) -> Iterator[Element]:
    """All elements below root, each before what it holds."""
    waiting = root.children[::-1]
    while waiting:
        e = waiting.pop()
        yield e
        waiting += e.children[::-1]


_PART = re.compile(r"\*|[#.]?[\w-]+|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|:not\(([^)]*)\)|:nth-child\(\s*([^)]*)\)|:(first|last|only)-child")
_TESTS = {"=": lambda a, b: a == b, "~=": lambda a, b: b in a.split(), "|=": lambda a, b: a == b or a.startswith(b + "-"), "^=": lambda a, b: bool(b) and a.startswith(b), "$=": lambda a, b: bool(b) and a.endswith(b), "*=": lambda a, b: bool(b) and b in a}


def _nth(said: str, place: int) -> bool:
    said = {"odd": "2n+1", "even": "2n"}.get(said.strip(), said.replace(" ", ""))
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", said):
        step, first = int({"": 1, "+": 1, "-": -1}.get(m[1], m[1])), int(m[2] or 0)
        return place == first if step == 0 else (place - first) % step == 0 and (place - first) // step >= 0
    return said.isdigit() and place == int(said)


def compound(selector: str, e: Element) -> bool:
    """Whether one element fits a selector without combinators."""
    at = 0
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m:
            return False
        part, at = m[0], m.end()
        siblings = e.parent.children if e.parent is not None else [e]
        place = next(i for i, s in enumerate(siblings, 1) if s is e)
        fits = (
            True if part == "*"
            else e.own.get("id") == part[1:] if part[0] == "#"
            else part[1:] in e.own.get("class", "").split() if part[0] == "."
            else m[1] in e.own and (not m[2] or _TESTS[m[2]](e.own[m[1]], m[3])) if part[0] == "["
            else not matches(m[4], e) if part.startswith(":not")
            else _nth(m[5], place) if part.startswith(":nth")
            else {"first": place == 1, "last": place == len(siblings), "only": len(siblings) == 1}[m[6]] if part[0] == ":"
            else e.tag == part.lower()
        )
        if not fits:
            return False
    return bool(selector)


def _fits(parts: list[str], e: Element) -> bool:
    """parts alternate compounds and combinators; the last compound is the element's."""
    if not compound(parts[-1], e):
        return False
    if len(parts) == 1:
        return True
    kind, rest = parts[-2], parts[:-2]
    if kind in (" ", ">"):
        above = e.parent
        while above is not None and above.tag:
            if _fits(rest, above):
                return True
            above = above.parent if kind == " " else None
        return False
    siblings = e.parent.children if e.parent is not None else [e]
    place = next(i for i, s in enumerate(siblings) if s is e)
    before = siblings[max(0, place - 1) : place] if kind == "+" else siblings[:place]
    return any(_fits(rest, s) for s in before)


def matches(selector: str, e: Element) -> bool:
    """Whether one of the selectors in a list fits the element."""
    for one in re.split(r",(?![^(\[]*[)\]])", selector):
        parts = re.split(r"\s*([>+~])\s*(?![^(\[]*[)\]])|\s+(?![^(\[]*[)\]])", one.strip())
        parts = [" " if p is None else p for p in parts]
        if one.strip() and all(parts) and _fits(parts, e):
            return True
    return False


def sheet_segments(sheet: str, label: str) -> Iterator[Segment]:
    """A segment for each rule that hides."""
    for rule in rules(sheet):
        if found := rule.hiding():
            yield Segment(f"{found.name}: {found.value}", False, "css_hidden", f"{label}, line {rule.line}, selector: {rule.selector}")


def fitting_segments(sheet: str, label: str, root: Element) -> Iterator[Segment]:
    """A segment for each rule that hides, is not marked important, and fits elements; with how many its first fitting selector fits."""
    for rule in rules(sheet):
        found = rule.hiding(important=False)
        if not found:
            continue
        every = [root, *everything(root)]
        count = next((n for one in re.split(r",(?![^(\[]*[)\]])", rule.selector) if (n := sum(matches(one, e) for e in every))), 0)
        if count:
            yield Segment(f"{found.name}: {found.value}", False, "css_hidden", f"{label}, line {rule.line}, selector: {rule.selector} (matched {count})")


def hiding_rules(text: str) -> list[tuple[Rule, int]]:
    """Rules of a page's own sheets that hide and fit, with the number of elements that their first fitting selector fits."""
    made = page(events(text))
    found = []
    for _, sheet in made.sheets:
        for rule in rules(sheet):
            if rule.hiding(important=False):
                every = [made.root, *everything(made.root)]
                count = next((n for one in re.split(r",(?![^(\[]*[)\]])", rule.selector) if (n := sum(matches(one, e) for e in every))), 0)
                if count:
                    found.append((rule, count))
    return found


def _conceals(e: Event) -> bool:
    return e.conceals(style_hides)


def _inline(made: Page) -> Iterator[str]:
    return (text for _, text in made.sheets if text.strip())


def html_css(data: bytes, limits: Limits, linked: list[tuple[str, str]] = ()) -> list[Segment]:  # type: ignore[assignment]
    """The page's segments, and one for every rule that hides, whether or not an element fits it; ``linked``: (name, sheet)."""
    seen = events(data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
    found = list(segments(seen, _conceals, OUTSIDE))
    for sheet in _inline(page(seen)):
        found += sheet_segments(sheet, "inline <style>")
    for name, sheet in linked:
        found += sheet_segments(sheet, f"<link> {name}")
    return found


def html_css_full(data: bytes, limits: Limits, linked: list[tuple[str, str]] = ()) -> list[Segment]:  # type: ignore[assignment]
    """From a tree: texts by element, rules that fit, elements hidden by their own attributes, spoken attributes, comments."""
    seen = events(data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
    made = page(seen)
    own = {id(e): "hidden" in e.own or e.own.get("aria-hidden") == "true" or style_hides(e.own.get("style", "")) for e in everything(made.root)}
    hidden = {id(made.root): False}
    found, inline, attributes = [], [], []
    for e in everything(made.root):
        hidden[id(e)] = hidden[id(e.parent)] or own[id(e)]
        if e.text.strip():
            found.append(Segment(e.text, not hidden[id(e)], "css_hidden" if hidden[id(e)] else "body", f"line {e.line}, <{e.tag}>"))
        if own[id(e)]:
            inline.append(Segment(e.own.get("style") or "(hidden attribute)", False, "css_hidden", f"line {e.line}, <{e.tag}> inline style"))
        attributes += spoken(Event("open", e.tag, e.line, e.own))
    for sheet in _inline(made):
        found += fitting_segments(sheet, "inline <style>", made.root)
    for name, sheet in linked:
        found += fitting_segments(sheet, f"<link> {name}", made.root)
    comments = [Segment(text, False, "comment", f"line {line}") for line, text in made.comments if len(text) >= LEAST]
    return [*found, *inline, *attributes, *comments]


def install(full: bool = False) -> None:
    """Read pages with their own style sheets from now on."""
    reading.register([".html", ".htm"], html_css_full if full else html_css)


# Linked sheets: a join by path.


def local_sheet(href: Column, folder: Column) -> Column:
    """The path that a link means, if it is a file inside the page's folder; null for other schemes and ways out of it."""
    plain = F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B")))
    outside = plain.rlike(r"(?i)^[a-z][a-z0-9+.-]*:|^/|(^|/)\.\.(/|$)")
    return F.when(~outside & (F.length(plain) > 0), F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(plain, r"^(\./)+", "")))


def linked(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """pages (folder, href, ...) with the sheet of that path from sheets (path, css), a join and no file access."""
    return pages.withColumn("path", local_sheet(F.col("href"), F.col("folder"))).join(sheets, "path", "left")


def extract(pages: DataFrame, sheets: DataFrame, full: bool = False) -> DataFrame:
    """pages (source, content, ...) with segments instead of content; sheets: (path, css) of all sheets that may be linked.

    One pass lists the links, an equi-join brings the sheets, grouped by page, and a second pass reads pages with them.
    """
    own = pages.withColumn("__row", F.xxhash64("source"))
    names = [c for c in own.columns if c != "content"]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, at, href) for s, c in zip(batch.column(0).to_pylist(), batch.column(1)) for at, (_, href) in enumerate(page(events((c.as_py() or b"").decode("utf-8", "replace"))).links)]
            source, at, href = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(at, pa.int32()), pa.array(href, pa.string())], ["source", "at", "href"])

    found = own.select("source", "content").mapInArrow(links, "source string, at int, href string").distinct()
    found = linked(found.withColumn("folder", F.regexp_replace("source", r"/[^/]*$", "")), sheets).filter(F.col("css").isNotNull())
    name = F.element_at(F.split("path", "/"), -1)
    by_page = found.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("at", name.alias("name"), "css"))).alias("__linked"))
    reader = html_css_full if full else html_css
    kind = pa.list_(pa.struct([("text", pa.string()), ("visible", pa.bool_()), ("kind", pa.string()), ("location", pa.string()), ("concealment", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 64):
                batch = whole.slice(cut, 64)
                given = zip(batch.column(0), batch.column(1).to_pylist())
                made = [[vars(s) for s in reader(c.as_py() or b"", Limits(), [(x["name"], x["css"]) for x in more or ()])] for c, more in given]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, kind)], [*names, "segments"])

    joined = own.join(by_page, "source", "left").select("content", "__linked", *names)
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names) + f", segments array<{SEGMENT}>"
    return joined.mapInArrow(read, schema).drop("__row")


# Declarations as a table, for the geometry lane.

DECLARED = "origin string, no int, tag string, id string, class string, html_line int, selector string, css_line int, name string, value string"


def declarations(pages: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and, for each declaration of a page's inline styles and own sheets, DECLARED; a row of origin link for each link, with its href as value."""
    kind = pages.schema[key].dataType.simpleString()
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in DECLARED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1)):
                made = _declarations((value.as_py() or b"").decode("utf-8", "replace"))
                at += [i] * len(made)
                rows += made
            columns = zip(*rows) if rows else ((),) * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], [key, *names])

    return pages.select(key, content).mapInArrow(run, f"`{key}` {kind}, {DECLARED}")


def _declarations(text: str) -> list[tuple]:
    seen = events(text)
    made = page(seen)
    rows: list[tuple] = []
    for e in seen:
        if e.kind == "open" and e.value not in ("style", "link") and e.attributes.get("style", "").strip():
            a = e.attributes
            for name, colon, value in (d.partition(":") for d in a["style"].split(";")):
                if colon and name.strip():
                    rows.append(("inline_style", len(rows), e.value, a.get("id") or None, a.get("class") or None, e.line, None, None, name.strip().lower(), value.strip()))
    for line, sheet in made.sheets:
        if sheet.strip():
            rows.append(("style_block", len(rows), None, None, None, line, None, None, "", ""))  # stands for the sheet itself
            rows += [("style_block", 0, None, None, None, line, r.selector, d.line, d.name, d.value) for r in rules(sheet) for d in r.declarations]
    rows += [("link", 0, None, None, None, line, None, None, "href", href) for line, href in made.links]
    return [(r[0], i, *r[2:]) for i, r in enumerate(rows)]


def sheet_declarations(sheets: DataFrame) -> DataFrame:
    """path, no, selector, css_line, name, value of each declaration of sheets (path, css)."""
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *d) for i, css in enumerate(batch.column(1).to_pylist()) for n, d in enumerate((r.selector, d.line, d.name, d.value) for r in rules(css or "") for d in r.declarations)]
            at, *columns = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], ["path", "no", "selector", "css_line", "name", "value"])

    return sheets.select("path", "css").mapInArrow(run, "path string, no int, selector string, css_line int, name string, value string")
