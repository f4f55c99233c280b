"""The corpus report as PDF, the same bytes for the same rows.

A small writer of PDF: objects in a fixed order, a cross-reference table, no dates and no identifiers but a digest of the
content, streams without compression.  Text of Latin-1 is set in Helvetica; other characters in a composite font of the
Japanese collection, which readers supply, with a map back to characters so that they can be searched.  Rows come in
parts of fixed size, each a file of its own beside the summary, so that a report of any number of documents can be made;
executors make the parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from veilmark.functions import language
from veilmark.operators import summary
from veilmark.sinks import files, pages

WIDTH, HEIGHT, MARGIN, BOTTOM = 595.28, 841.89, 40.0, 46.0
PART_ROWS = 2000
LONGEST = 100
_COLUMNS = (0.0, 230.0, 285.0, 375.0)
_RIGHT = WIDTH - 2 * MARGIN


def _number(x: float) -> str:
    return f"{x:.2f}".rstrip("0").rstrip(".")


def _latin(text: str) -> bool:
    return all(" " <= c < "\x7f" or "\xa0" <= c <= "\xff" for c in text)


def _string(text: str) -> tuple[str, bytes]:
    """(font, string operand) of a text."""
    if _latin(text):
        return "F1", b"(" + text.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    return "F2", b"<" + text.encode("utf-16-be", "replace").hex().upper().encode() + b">"


def shown(text: str) -> str:
    """A text on one line, with what can't be printed as marks."""
    return "".join(c if c.isprintable() else f"[U+{ord(c):04X}]" for c in text)


def width(text: str, size: float) -> float:
    """At most how wide a text is: wide characters count one size, Latin ones what capitals of Helvetica have on average."""
    return size * sum(1.0 if c > "\xff" else 0.28 if c in "ijl.,:;'|!() ftI" else 0.89 if c in "MWmw@%" else 0.72 if c.isupper() else 0.57 for c in text)


def fitted(text: str, size: float, room: float) -> list[str]:
    """The text in lines that have room."""
    lines, line, used = [], "", 0.0
    for c in text:
        w = width(c, size)
        if line and used + w > room:
            lines.append(line)
            line, used = "", 0.0
        line, used = line + c, used + w
    return [*lines, line]


class Paper:
    """Pages that are written from top to bottom."""

    def __init__(self) -> None:
        self.pages: list[list[bytes]] = []
        self.y = 0.0

    def room(self, height: float) -> None:
        if not self.pages or self.y - height < BOTTOM:
            self.pages.append([])
            self.y = HEIGHT - MARGIN

    def text(self, x: float, y: float, size: float, said: str, grey: float = 0.0) -> None:
        font, operand = _string(said)
        self.pages[-1].append(f"BT {_number(grey)} g /{font} {_number(size)} Tf {_number(MARGIN + x)} {_number(y)} Td ".encode() + operand + b" Tj ET")

    def box(self, x: float, y: float, w: float, h: float, colour: Sequence[float]) -> None:
        self.pages[-1].append((" ".join(map(_number, colour)) + f" rg {_number(MARGIN + x)} {_number(y)} {_number(w)} {_number(h)} re f").encode())

    def line(self, said: str, size: float = 9.0, after: float = 3.0, x: float = 0.0) -> None:
        for piece in fitted(shown(said), size, _RIGHT - x):
            self.room(size + after)
            self.y -= size
            self.text(x, self.y, size, piece)
            self.y -= after

    def bytes(self) -> bytes:
        objects: list[bytes] = [b"", b""]
        add = lambda body: objects.append(body) or len(objects)
        latin = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
        below = add(b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /HeiseiKakuGo-W5 /CIDSystemInfo << /Registry (Adobe) /Ordering (Japan1) /Supplement 2 >> /DW 1000 /FontDescriptor 6 0 R >>")
        map_ = b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"
        unicode_ = add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(map_), map_))
        add(b"<< /Type /FontDescriptor /FontName /HeiseiKakuGo-W5 /Flags 4 /FontBBox [-92 -250 1010 922] /ItalicAngle 0 /Ascent 752 /Descent -221 /CapHeight 737 /StemV 114 >>")
        wide = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /HeiseiKakuGo-W5-UniJIS-UCS2-H /Encoding /UniJIS-UCS2-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (below, unicode_))
        kids = []
        for number, operations in enumerate(self.pages, 1):
            foot = f"BT 0.5 g /F1 8 Tf {_number(WIDTH / 2 - 20)} 26 Td ({number} / {len(self.pages)}) Tj ET".encode()
            content = b"\n".join([*operations, foot])
            stream = add(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content))
            kids.append(add(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 %d 0 R /F2 %d 0 R >> >> >>" % (stream, latin, wide)))
        objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
        objects[1] = b"<< /Type /Pages /Count %d /MediaBox [0 0 %s %s] /Kids [%s] >>" % (len(kids), _number(WIDTH).encode(), _number(HEIGHT).encode(), b" ".join(b"%d 0 R" % k for k in kids))
        out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
        for number, body in enumerate(objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        start, digest = len(out), hashlib.sha256(out).hexdigest()[:32].encode()
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        out += b"trailer\n<< /Size %d /Root 1 0 R /ID [<%s> <%s>] >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, digest, digest, start)
        return bytes(out)


_TINT = {"flagged": (1.0, 0.93, 0.93), "unparsed": (0.94, 0.94, 0.94)}


def listing(paper: Paper, rows: list[dict]) -> None:
    """The table of documents: path, mask, which of the seven hold, and the first thing said."""
    size = 7.5
    paper.room(3 * size)
    paper.y -= size
    for x, head in zip(_COLUMNS, ("path", "mask", "H1 - H7", "evidence")):
        paper.text(x, paper.y, size, head, 0.4)
    paper.y -= 4
    for row in rows:
        cells = [fitted(shown(row["path"] or ""), size, _COLUMNS[1] - 6), [row["mask"]], None, fitted(shown(row["evidence"] or ""), size, _RIGHT - _COLUMNS[3])]
        height = (size + 2) * max(len(c) for c in cells if c)
        paper.room(min(height, HEIGHT - MARGIN - BOTTOM - 1))
        if row["class"] in _TINT:
            paper.box(-2, paper.y - height - 1, _RIGHT + 4, height, _TINT[row["class"]])
        for i, on in enumerate(row["bits"]):
            paper.text(_COLUMNS[2] + 12 * i, paper.y - size, 6, f"H{i + 1}", 0.0 if on else 0.75)
        for x, lines in zip(_COLUMNS, cells):
            for n, piece in enumerate(lines or ()):
                paper.text(x, paper.y - size - n * (size + 2), size, piece)
        paper.y -= height


def bars(paper: Paper, title: str, counts: list[tuple[str, int]]) -> None:
    paper.line(title, 12, 5)
    most = max((n for _, n in counts), default=0) or 1
    for name, n in counts:
        paper.room(13)
        paper.y -= 10
        paper.text(0, paper.y, 9, shown(name)[:60])
        paper.box(230, paper.y - 1, round(200 * n / most, 2), 9, (0.4, 0.6, 0.8))
        paper.text(440, paper.y, 9, str(n))
        paper.y -= 3


def opening(source: str, totals: dict[str, int], masks: list[tuple[str, int]], hypotheses: list[tuple[str, int]], lang: str = "en", charts: bool = True) -> Paper:
    """A paper that begins with the corpus in numbers."""
    paper = Paper()
    paper.line("Observation report", 18, 6)
    paper.line(source, 9, 4)
    paper.line("   ".join(f"{k}: {v}" for k, v in totals.items()), 9, 6)
    paper.line("An observation, not a judgment of intent; a person must decide what it means.", 9, 10)
    named = [(f"{h} {language.label(h, lang)}", n) for h, n in hypotheses]
    for title, counts in (("Observations", named), ("Masks", masks)):
        if charts:
            bars(paper, title, counts)
        else:
            paper.line(title, 12, 5)
            for name, n in counts:
                paper.line(f"{name}: {n}")
        paper.y -= 8
    return paper


def write(observed: DataFrame, folder: str, source: str, base: str | None = None, lang: str = "en", charts: bool = True, part_rows: int = PART_ROWS, staged: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """``report.pdf`` in folder, with all rows if they are few; else with the numbers, and the rows in ``parts/``.  How many parts."""
    ordered = lambda rows, key: sorted((r[key], r["documents"]) for r in rows.collect())
    totals = summary.totals(observed).first().asDict()
    masks, hypotheses = ordered(summary.mask_counts(observed), "mask"), ordered(summary.hypothesis_counts(observed), "hypothesis")
    parts = pages.paged(pages.rows(observed, base, 1, LONGEST), part_rows, staged)
    count = -(-totals["total"] // part_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                paper = opening(source, totals, masks, hypotheses, lang, charts) if count == 1 else Paper()
                if count > 1:
                    paper.line(f"{source}: part {number} of {count}", 9, 6)
                listing(paper, rows.as_py())
                name = "report.pdf" if count == 1 else f"parts/{number:09}.pdf"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([paper.bytes()], pa.binary())], ["name", "body"])

    made = parts.mapInArrow(run, "name string, body binary")
    if count != 1:
        paper = opening(source, totals, masks, hypotheses, lang, charts)
        paper.line(f"The documents are listed in {count} parts.", 9)
        made = made.unionByName(observed.sparkSession.createDataFrame([("report.pdf", bytearray(paper.bytes()))], "name string, body binary"))
    files.write(made, folder)
    return count
