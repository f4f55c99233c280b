from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import chartable, contract, detect
from veilmark.operators import control_syntax, geometry, report, summary
from veilmark.sources import css, formats, html, metadata, pdf, png, reading

LIMITS = reading.Limits()


def page(content: str, flate: bool = False, extra: str = "", forms: str = "", more: tuple[str, ...] = ()) -> bytes:
    body = zlib.compress(content.encode()) if flate else content.encode()
    head = f"<< /Length {len(body)} {'/Filter /FlateDecode' if flate else ''} >>"
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R /OCProperties << /D << /OFF [20 0 R] >> >> >> endobj",
        b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >> endobj",
        f"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /Im 7 0 R {forms} >> /Properties << /L 20 0 R /M 21 0 R /V 22 0 R >> >> {extra} >> endobj".encode(),
        f"4 0 obj {head}\nstream\n".encode() + body + b"\nendstream endobj",
        b"5 0 obj << /Title (A long enough title) /Author (short) >> endobj",
        b"6 0 obj << /Type /Annot /Contents (A note \\(long\\) enough) >> endobj",
        b"7 0 obj << /Type /XObject /Subtype /Image >> endobj",
        b"20 0 obj << /Type /OCG /Name (Hidden  one) >> endobj",
        b"21 0 obj << /Type /OCMD /OCGs [20 0 R 23 0 R] /P /AllOn >> endobj",
        b"22 0 obj << /Type /OCMD /OCGs [20 0 R] /VE [] >> endobj",
        b"23 0 obj << /Type /OCG /Name (Shown) >> endobj",
        *(m.encode() for m in more),
    ]
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\ntrailer << /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF"


def pieces(content: str, **how) -> list[tuple[str, str]]:
    return [(s.text, s.location) for s in pdf.pdf(page(content, **how), LIMITS) if s.kind in ("body", "css_hidden")]


@pytest.mark.parametrize(
    ("content", "label"),
    [
        ("BT /F1 12 Tf 3 Tr 72 700 Td (secret) Tj ET", "invisible text, Tr 3"), ("BT /F1 12 Tf 7 Tr 72 700 Td (secret) Tj ET", "invisible text, Tr 7"),
        ("BT /F1 1.9 Tf 72 700 Td (secret) Tj ET", "tiny_font"), ("BT /F1 2.0 Tf 72 700 Td (secret) Tj ET", None), ("q 0.1 0 0 0.1 0 0 cm BT /F1 12 Tf 72 700 Td (secret) Tj ET Q", "tiny_font"),
        ("BT /F1 12 Tf -72 700 Td (secret) Tj ET", "off_page"), ("1 g BT /F1 12 Tf 72 700 Td (secret) Tj ET", "white_text"), ("0 0 0 0 k BT /F1 12 Tf 72 700 Td [(sec) -20 (ret)] TJ ET", "white_text"),
        ("1 0 0 rg 50 650 300 100 re f 1 g BT /F1 12 Tf 72 700 Td (secret) Tj ET", None), ("1 g BT /F1 12 Tf 72 700 Td (secret) Tj ET 1 0 0 rg 50 650 300 100 re f", "white_text"),
        ("1 0 0 rg 70 690 20 30 re f 1 g BT /F1 12 Tf 72 700 Td (secret) Tj ET", "white_text"), ("0 g BT /F1 12 Tf 72 700 Td <736563726574> Tj ET", None),
        ("q 300 0 0 100 50 650 cm /Im Do Q 1 g BT /F1 12 Tf 72 700 Td (secret) Tj ET", None),
    ],
)
def test_hidden_pdf_text(content, label):
    for flate in (False, True):
        found = pieces(content, flate=flate)
        assert found == ([("secret", "page 1")] if label is None else [("secret", f"page 1 ({label})")])  # a page without visible text has no body


def test_pdf_parts_and_failures():
    found = {(s.kind, s.text, s.location) for s in pdf.pdf(page("BT /F1 12 Tf 72 700 Td (x) Tj ET", extra="/Annots [6 0 R]"), LIMITS)}
    assert found == {("metadata", "A long enough title", "PDF metadata / Title"), ("body", "x", "page 1"), ("comment", "A note (long) enough", "page 1 annotation #1")}
    assert pieces("BT /F1 (x) Tf ET") == [("", "page 1 (Extraction failed)")]
    with pytest.raises(ValueError):
        pdf.pdf(page("") + b"/Encrypt", LIMITS)


def form(number: int, content: str, extra: str = "") -> str:
    return f"{number} 0 obj << /Type /XObject /Subtype /Form /Length {len(content)} {extra} >>\nstream\n{content}\nendstream endobj"


SHOW = "BT /F1 12 Tf 72 700 Td (%s) Tj ET"


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("/OC /L BDC " + SHOW % "x" + " EMC " + SHOW % "y", [("y", "page 1"), ("x", "page 1 (off_layer 'Hidden one')")]),
        ("/OC /M BDC " + SHOW % "x" + " EMC", [("x", "page 1 (off_layer '/M')")]),
        ("/OC /V BDC " + SHOW % "x" + " EMC", [("", "page 1 (Extraction failed)")]),
        ("/OC /None BDC " + SHOW % "x" + " EMC", [("", "page 1 (Extraction failed)")]),
        ("/Span << /A 1 >> BDC q " + SHOW % "x" + " Q EMC", [("x", "page 1")]),
        ("3 Tr /Fm Do", [("inner", "page 1 (form '/Fm', invisible text, Tr 3)")]),
        ("/Fm Do 0 g /Fm Do", [("innerinner", "page 1")]),
        ("/Fm Do 1 g /Fm Do", [("", "page 1 (Extraction failed)")]),
        (SHOW % "x", [("x", "page 1")]),
        ("/Round Do", [("", "page 1")][:0]),
        ("/Deep Do", [("far", "page 1 (form '/Fx', off_layer 'Hidden one')")]),
    ],
)
def test_forms_and_layers(content, want):
    forms = "/Fm 10 0 R" if "/Fm" in content else "/Round 11 0 R" if "/Round" in content else "/Deep 12 0 R" if "/Deep" in content else ""
    more = (
        form(10, SHOW % "inner"), form(11, "/Self Do", "/Resources << /XObject << /Self 11 0 R >> >>"),
        form(12, "/Fx Do", "/Resources << /XObject << /Fx 13 0 R >> >>"), form(13, SHOW % "far", "/OC 20 0 R"),
    )
    assert pieces(content, forms=forms, more=more) == want


def test_counts_and_loose_forms():
    made = page("0 g 50 650 300 100 re f 1 g " + SHOW % "x" + " /Pattern cs /P1 scn " + SHOW % "y", forms="/Fm 10 0 R", more=(form(10, SHOW % "loose\\342\\200"),))
    found = pdf.pdf(made, LIMITS)
    assert found.counts == {"color_unresolved": 1, "white_on_painted": 1} and [s.text for s in found if s.kind == "body"] == ["xy"]
    where, counts = pdf.audit(page("BT /F1 0.1 Tf ET", forms="/Fm 10 0 R", more=(form(10, "BT /F1 0.2 Tf ET"),)))
    assert [(o, w, m) for o, w, _, m in where] == [("page_stream", "page 1", [0.1]), ("form_stream", "page 1 (form '/Fm')", [0.2])]
    assert counts == {"pages": 1, "page_streams": 1, "form_xobjects": 1, "streams_unreadable": 0, "operators_seen": 6}


def test_labels_are_clean():
    assert pdf.cleaned("a\t b\u200b\x00 " + "c" * 50) == "a b " + "c" * 36 + "..." and pdf.cleaned("\u200b") == ""


def test_pdf_geometry():
    found = pdf.geometry(page("BT /F1 0.5 Tf 1 0 0 1 700 10 Tm 1 0 0 1 612 792 Tm /F1 0.51 Tf ET"))
    assert found == [("pdf_font_size_tiny", "page 1", [0.5]), ("pdf_text_out_of_bounds", "page 1", [700.0, 10.0])]


def image(rgba: np.ndarray, kind: int = 6, row_filter: int = 0, text: str = "") -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    height, width, n = rgba.shape
    rows = rgba.astype(np.int64)
    if row_filter == 2:
        rows = np.concatenate([rows[:1], rows[1:] - rows[:-1]]) & 255
    elif row_filter == 1:
        rows = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], axis=1) & 255
    raw = b"".join(bytes([row_filter]) + rows[y].astype(np.uint8).tobytes() for y in range(height))
    extra = chunk(b"tEXt", b"Comment\0" + text.encode()) if text else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("row_filter", [0, 1, 2])
def test_png(row_filter):
    clear = np.tile(np.array([255, 0, 0, 0], np.uint8), (100, 200, 1))
    found = png.png(image(clear, row_filter=row_filter, text="ignore this picture"), LIMITS)
    assert [(s.kind, s.location) for s in found] == [("metadata", "PNG tEXt / Comment"), ("css_hidden", "first hit at (0, 0)")]
    plain = np.full((50, 50, 3), 255, np.uint8)
    assert png.png(image(plain, 2, row_filter), LIMITS) == []
    faint = plain.copy()
    faint[10:20, :, :] = (240 - np.arange(50) % 10)[None, :, None]
    assert [s.text[:12] for s in png.png(image(faint, 2, row_filter), LIMITS)] == ["low contrast"]
    faint[10:20, :, :] = (np.arange(50) % 10)[None, :, None]
    assert png.png(image(faint, 2, row_filter), LIMITS) == []


PAGE = "<style>\n.x, p { color:red; display : none }\n/* a\n */ #y{opacity:0}\n@media print{.z{display:none}}\n.w{display:block}</style><p class='x y'>a</p><div id=q><b>c</b><i data-k='a b'>d</i></div>"


def test_css_segments():
    found = [(s.text, s.location) for s in css.html_css(PAGE.encode(), LIMITS) if s.location.startswith("inline")]
    assert found == [("display: none", "inline <style>, line 2, selector: .x, p"), ("opacity: 0", "inline <style>, line 4, selector: #y")]
    assert [(r.selector, n) for r, n in css.hiding_rules(PAGE)] == [(".x, p", 1)]
    hidden = ("text-indent:-100px", "clip:rect(0,0,0,0)", "clip-path: inset(100%)", "left:-1000px", "font-size:0%")
    shown = ("text-indent:-10px", "left:-999px", "width:0", "height:0", "font-size:0.1px", "display:block")
    assert all(css.hides(*d.split(":")) for d in hidden) and not any(css.hides(*d.split(":")) for d in shown)


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 1), ("P.x.y", 1), (".x .y", 0), ("div > b", 1), ("div b + i", 1), ("b ~ i", 1), ("[data-k]", 1), ("[data-k~=b]", 1), ("[data-k^='a ']", 1), ("i:not(.x)", 1), ("#q :nth-child(2n+1)", 1), ("#q :last-child", 1), ("*", 4), ("q, b", 1), ("::before", 0)],
)
def test_selectors(selector, n):
    assert sum(css.matches(selector, e) for e in css.everything(css.page(html.events(PAGE)).root)) == n


def test_linked_sheets(spark):
    pages = spark.createDataFrame([(1, "/w/a", "s.css"), (2, "/w/a", "../s.css"), (3, "/w/a", "https://h/s.css"), (4, "/w/a/", "./sub/s.css"), (5, "/w/a", "/w/a/s.css")], "i int, folder string, href string")
    sheets = spark.createDataFrame([("/w/a/s.css", "A"), ("/w/s.css", "B"), ("/w/a/sub/s.css", "C")], "path string, css string")
    assert {r.i: r.css for r in css.linked(pages, sheets).collect()} == {1: "A", 2: None, 3: None, 4: "C", 5: None}


def test_reports(spark):
    segments = F.array(F.struct(F.col("t").alias("text"), F.lit(True).alias("visible"), F.lit("body").alias("kind"), F.lit("line 1").alias("location"), F.lit(None).cast("string").alias("concealment")))
    rows = spark.createDataFrame([("a.txt", "​" * 20)], "source string, t string").select("source", detect.observe(segments).alias("o"), detect.evidence(segments).alias("e"))
    said = rows.select(report.text_report(F.col("source"), F.col("o"), F.col("e")).alias("r"), report.json_receipt(F.col("o")).alias("j")).first()
    assert "  Mask    : 1100-001" in said.r and "  - 20 zero-width chars (line 1)\n" in said.r and said.j.startswith('{"h1":1,')
    page = spark.createDataFrame([("<a>", "x​")], "source string, t string").select(report.html_report(F.col("source"), detect.observe(segments), detect.evidence(segments), segments).alias("h")).first().h
    assert '<h1>&lt;a&gt;</h1><p class="mask" data-mask="1100-000"><span class="on">1</span><span class="on">1</span><span class="off">0</span>' in page and "<td>H2</td><td>Zero-width density</td><td class=\"on\">DETECTED</td>" in page and '<td>x<span class="inv zw">U+200B</span></td>' in page
    assert report.receipt({"é": 1}) == '{\n  "é": 1\n}\n'
    made = report.dashboard(summary.totals(rows), summary.mask_counts(rows), summary.hypothesis_counts(rows), summary.extension_counts(rows), "ja")
    assert "1100-001" in made and "ゼロ幅密度" in made


def test_rules_of_odd_sheets():
    sheet = "<!-- /* } */ @import 'x;y'; a::after { content: '}'; color: red !IMPORTANT } -->\n@media x { b { opacity: 0 } } c\n{ *zoom: 1; display : none; --x: { y: z } } d { font-size: 0"
    found = [(r.selector, r.line, [(d.name, d.value, d.line, d.important) for d in r.declarations]) for r in css.rules(sheet)]
    assert found == [
        ("a::after", 1, [("content", "'}'", 1, False), ("color", "red", 1, True)]),
        ("c", 2, [("display", "none", 3, False), ("--x", "{ y: z }", 3, False)]),
        ("d", 3, [("font-size", "0", 3, False)]),
    ]


def test_linked_sheets_stay_in_the_folder(spark):
    pages = spark.createDataFrame([("f/a.html", b"<link rel=stylesheet href='s/x%20y.css'><link rel=stylesheet href='../f/s.css'><link rel=stylesheet href='/abs.css'><p>t</p>")], "source string, content binary")
    sheets = spark.createDataFrame([("f/s/x y.css", "p { display:none }"), ("f/s.css", "p { opacity:0 }"), ("/abs.css", "p { opacity:0 }")], "path string, css string")
    for full, end in ((False, ""), (True, " (matched 1)")):
        (row,) = css.extract(pages, sheets, full).collect()
        assert [(s.kind, s.text, s.location) for s in row.segments] == [("body", "t", "line 1, <p>" if full else "line 1"), ("css_hidden", "display: none", f"<link> x y.css, line 1, selector: p{end}")]


def test_geometry_white_space_and_receipt(spark):
    page_ = b"<p style='color:red;\n  font-size:\n0'>a</p><p style='\topacity:0'>b</p><style>q { line-height: 0 !important }</style>"
    table = geometry.declared(spark.createDataFrame([("p.html", page_)], "source string, content binary"))
    found = geometry.audit(table)
    assert sorted((r.origin, r.rule, r.value, r.location) for r in found.collect()) == [
        ("inline_style", "font_size_tiny", "0", "line 1, <p>"), ("inline_style", "opacity_near_zero", "0", "line 3, <p>"),
        ("style_block", "line_height_zero", "0", "inline <style> (html line 3), css line 1, selector: q"),
    ]
    assert [tuple(r) for r in geometry.scanned(table).collect()] == [("p.html", 3, 1, 0, 0)]
    (told,) = geometry.receipt(found, geometry.load()).collect()
    assert told.text.count("\n- ") == 3 and len(json.loads(told.json)["observations"]) == 3


def test_pinned_digests():
    """Digests of the built-in vocabulary and thresholds, the same from a document of the same content."""
    assert control_syntax.vocabulary().sha256 == "27734e17bd334d7a66ffad7b5a9e1ebe8c918d3badc8b6240d115d9804956fbf"
    assert geometry.load().sha256 == "70f2bdb5f29ffbd7a73bae318a3da5c7195dec30fb8d71cd7bb2ef0759fa4540"
    patterns = [{"category": c, "name": n, "pattern": p, "description": d} for c, n, p, d in control_syntax.VOCABULARY]
    document = json.dumps({"lane": "x", "backing_kinds": ["metadata"], "patterns": patterns})
    assert control_syntax.vocabulary(document, "file").sha256 == control_syntax.vocabulary().sha256
    assert geometry.load(json.dumps({"version": "9", "thresholds": geometry.THRESHOLDS}), "file").sha256 == geometry.load().sha256
    assert geometry.load("{not json").source == control_syntax.vocabulary("{not json").source == "embedded"
    for bad in ({"thresholds": {}}, {"thresholds": geometry.THRESHOLDS, "more": 1}, {"thresholds": geometry.THRESHOLDS | {"opacity_max": 2}}):
        with pytest.raises(contract.ContractError):
            geometry.load(json.dumps(bad))
    for bad in ({"patterns": [{"category": "", "name": "n", "pattern": "p"}]}, {"patterns": [], "backing_kinds": [""]}, {"patterns": [{"category": "c", "name": "n", "pattern": "(", "match": "regex"}]}):
        with pytest.raises(contract.ContractError):
            control_syntax.vocabulary(json.dumps(bad))


def test_control_receipt(spark):
    used = control_syntax.vocabulary()
    rows = [(1, 0, "body", "line 1", "x [INST] y"), (1, 1, "metadata", "m", "[INST]"), (2, 0, "comment", None, "[OVERRIDE][OVERRIDE]")]
    hits = control_syntax.scan(spark.createDataFrame(rows, "doc_id long, seg_no int, kind string, location string, text string"), used.table(spark), used.backing)
    found = {r.doc_id: r for r in control_syntax.receipt(hits, used).collect()}
    assert found[1].n_backed == 1 and found[1].text.endswith("findings: 1\n- [special_tokens] llama_inst_start @ line 1, offset 2: x [INST] y\n")
    assert [f["offset"] for f in json.loads(found[2].json)["findings"]] == [0, 10]


def test_diagnostics(spark):
    rows = spark.createDataFrame([("a​" * 3 + "bcd", "cp932", {"b": 2, "a": 1}, "ok"), ("", None, None, "ok"), ("x", None, None, "Extraction failed: X")], "t string, e string, c map<string,bigint>, s string")
    found = [json.loads(r[0]) for r in rows.select(detect.diagnostics(F.col("t"), F.col("e"), F.col("c"), F.col("s"))).collect()]
    same = {"zero_width_threshold": 0.01, "payload_min_length": 16, "oob_min_length": 10, "version": detect.VERSION}
    assert found == [{"zero_width_density": 0.3333, **same, "encoding_name": "cp932", "a": 1, "b": 2}, {"zero_width_density": 0.0, **same}, {"version": detect.VERSION}]


def test_last_suffixes(spark):
    names = ["a.txt", "foo..txt", ".txt", "..txt", "a.txt.", "A.B.C", "none"]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(reading.suffix(F.col("n"))).collect()]
    assert found == [".txt", ".txt", "", ".txt", "", ".C", ""]


def tiff(tags: list[tuple[int, int, bytes]], sub: list[tuple[int, int, bytes]] = (), order: str = "<") -> bytes:
    def entries(rows, at):
        body, data = b"", b""
        start = at + 2 + 12 * len(rows) + 4
        for tag, kind, raw in rows:
            size = {1: 1, 2: 1, 4: 4, 7: 1}[kind]
            place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + len(data))
            data += raw if len(raw) > 4 else b""
            body += struct.pack(order + "HHI", tag, kind, len(raw) // size) + place
        return struct.pack(order + "H", len(rows)) + body + struct.pack(order + "I", 0) + data

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    rows = [*tags, (metadata.SUB_DIRECTORY, 4, struct.pack(order + "I", 0))] if sub else tags
    first = entries(rows, 8)
    if not sub:
        return head + first
    rows[-1] = (metadata.SUB_DIRECTORY, 4, struct.pack(order + "I", 8 + len(first)))
    return head + entries(rows, 8) + entries(sub, 8 + len(first))


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    made = tiff([(270, 2, b"a long description\0"), (271, 2, b"short\0"), (40092, 1, "a comment in sixteen".encode("utf-16-le"))], [(37510, 7, b"UNICODE\0" + "user's comment".encode("utf-16-be"))], order)
    want = [("a long description", "EXIF / ImageDescription (tag 270)"), ("a comment in sixteen", "EXIF / XPComment (tag 40092)"), ("user's comment", "EXIF / UserComment (tag 37510)")]
    xmp = b"<x:xmpmeta>packet</x:xmpmeta>"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(made)) + b"Exif\0\0" + made + b"\xff\xe1" + struct.pack(">H", 31 + len(xmp)) + b"http://ns.adobe.com/xap/1.0/\0" + xmp + b"\xff\xda"
    webp = b"RIFF" + struct.pack("<I", 0) + b"WEBP" + b"EXIF" + struct.pack("<I", len(made)) + made + b"\0" * (len(made) % 2) + b"XMP " + struct.pack("<I", len(xmp)) + xmp
    assert [(s.text, s.location) for s in metadata.image(made, LIMITS)] == want
    assert [(s.text, s.location) for s in metadata.image(jpeg, LIMITS)] == [(s.text, s.location) for s in metadata.image(webp, LIMITS)] == [*want, (xmp.decode(), "XMP packet")]
    assert metadata.image(b"BM1234", LIMITS) == metadata.image(b"GIF89a", LIMITS) == []
    for broken in (b"", b"text", made[:5]):
        with pytest.raises(ValueError):
            metadata.image(broken, LIMITS)
    for cut in range(8, len(made)):
        metadata.image(made[:cut], LIMITS)  # never an error


def test_formats_say_what_is_missing():
    said = formats.install()
    assert reading.registered(".html") is css.html_css_full and said["PDF"] == "" and said["text in pictures"] and said["text in pictures of PDF"]
    formats.install("HTML")
    assert reading.registered("html") is html.html
    with pytest.raises(ValueError):
        formats.install("nothing")


def test_display_paths(spark):
    rows = spark.createDataFrame([("/c/d/e.txt",), ("/x/y.txt",)], "source string")
    assert [r[0] for r in rows.select(report.display_path(F.col("source"), "/c")).collect()] == ["d/e.txt", "y.txt"]


TABLE = {
    "schema": "x-chartable/1", "version": 1, "description": "", "invisible": {"bidi_control": [["202A", "202E"]], "tag": [["E0000", "E007F"]], "variation_selector": ["FE00"], "zero_width": ["200B"]},
    "twins": {"0410": "A"}, "fullwidth_ascii": {"from": "FF01", "to": "FF5E", "base": "0021"}, "spaces": ["3000"], "dashes": ["2010"],
}


def test_pinned_character_table(spark, tmp_path):
    raw = json.dumps(TABLE).encode()
    pin = hashlib.sha256(raw).hexdigest()
    (tmp_path / "t.json").write_bytes(raw)
    source, target = chartable.read(str(tmp_path / "t.json"), pin).fold_pairs(dashes=True)
    rows = spark.createDataFrame([("\u0410\uff21\u3000\u2010\u200b\u202ax",)], "t string")
    assert rows.select(F.translate("t", source, target)).first()[0] == "AA -x"
    faults = [
        {"schema": "other"}, {"version": True}, {"version": 2}, {"description": None}, {"invisible": {}}, {"invisible": TABLE["invisible"] | {"tag": []}}, {"invisible": TABLE["invisible"] | {"tag": [["2", "1"]]}},
        {"twins": {}}, {"twins": {"0410": "AB"}}, {"twins": {"zz": "A"}}, {"fullwidth_ascii": {"from": "FF01"}}, {"fullwidth_ascii": {"from": "FF01", "to": "FF5E", "base": "0070"}}, {"dashes": ["2010", "2010"]}, {"spaces": None},
    ]
    for fault in faults:
        with pytest.raises(chartable.TableError):
            chartable.parse(TABLE | fault)
    for bad in (lambda: chartable.load(raw), lambda: chartable.read(str(tmp_path / "none")), lambda: chartable.load(b"{", hashlib.sha256(b"{").hexdigest()), lambda: chartable.parse([])):
        with pytest.raises(chartable.TableError):
            bad()


def test_large_files_are_listed_but_not_read(spark, tmp_path):
    for name, size in (("b.txt", 10), ("a.txt", 30), ("c.TXT", 20)):
        (tmp_path / name).write_text("x" * size)
    found = reading.ordered(reading.scan(spark, str(tmp_path), file_bytes=20))
    assert [(r.source[-5:], r.length, r.content is None) for r in found.collect()] == [("a.txt", 30, True), ("b.txt", 10, False), ("c.TXT", 20, False)]
    assert {r.source[-5:]: r.status for r in reading.extract(found).collect()}["a.txt"] == "Extraction refused: file_too_large"
