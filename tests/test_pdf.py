from __future__ import annotations

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from veilmark.functions import detect
from veilmark.sources import pdf, pdf_filters, pdf_fonts, reading

LIMITS = reading.Limits()


def document(content: bytes | str, resources: str = "", objects: dict[int, str | tuple[str, bytes]] | None = None, head: str = "") -> bytes:
    """A page of this content; further objects are a value, or a dictionary and a stream."""
    content = content.encode("latin-1") if isinstance(content, str) else content
    made: dict[int, bytes] = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << {resources} >> >>".encode(),
        4: f"<< /Length {len(content)} {head} >>\nstream\n".encode() + content + b"\nendstream",
    }
    for number, value in (objects or {}).items():
        made[number] = value.encode() if isinstance(value, str) else f"<< {value[0]} /Length {len(value[1])} >>\nstream\n".encode() + value[1] + b"\nendstream"
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj %s endobj" % (n, v) for n, v in made.items()) + b"\ntrailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def read(*how, **named) -> list[tuple[str, str]]:
    return [(s.text, s.location) for s in pdf.pdf(document(*how, **named), LIMITS)]


MAP = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0044> <D83DDE00> endbfchar
2 beginbfrange <0010> <0013> <0430> <0020> <0021> [<00660069> <006C>] endbfrange endcmap end"""


def test_composite_font():
    objects = {10: "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [11 0 R] /ToUnicode 12 0 R >>", 11: "<< /Type /Font /Subtype /CIDFontType2 /DW 500 /W [16 [600 700] 32 40 800] >>", 12: ("", MAP)}
    found = read("BT /F1 12 Tf 72 700 Td <00100011000300130020002100440055> Tj ET", "/Font << /F1 10 0 R >>", objects)
    assert found == [("аб гfil\U0001f600U", "page 1")]
    file = pdf.File(document("", "", objects))
    font = pdf_fonts.Font(file, pdf.Ref(10))
    assert font.read(bytes.fromhex("0010001100030020")) == ("аб fi", pytest.approx(0.6 + 0.7 + 0.5 + 0.8), pytest.approx(2.6))
    named = pdf_fonts.Font(pdf.File(document("", "", {10: "<< /Subtype /Type0 /Encoding /90ms-RKSJ-H /DescendantFonts [] >>"})), pdf.Ref(10))
    assert named.read("日本".encode("cp932"))[0] == "日本"


def test_differences_and_encodings():
    font = "<< /Type /Font /Subtype /Type1 /FirstChar 1 /Widths [500 1000] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /eacute 5 /uni0434 /alpha /afii10065 /Ydieresis /u1F600 /unknownglyph] >> >>"
    content = b"BT /F1 12 Tf 72 700 Td (\x01\x02\x05\x06\x07\x08\x09\x80A) Tj ET"
    assert read(content, "/Font << /F1 10 0 R >>", {10: font}) == [("fiéдαаŸ\U0001f600€A", "page 1")]
    assert read(b"BT /F1 12 Tf 72 700 Td (\x8e) Tj ET", "/Font << /F1 << /Type /Font /Encoding /MacRomanEncoding >> >>") == [("é", "page 1")]


@pytest.mark.parametrize(("name", "want"), [("A", "A"), ("germandbls", "ß"), ("Scaron", "Š"), ("Omega", "Ω"), ("afii10023", "Ё"), ("afii10017", "А"), ("afii10024", "Ж"), ("afii10097", "я"), ("afii10071", "ё"), ("afii10065", "а"), ("f_i", "fi"), ("a.sc", "a"), ("uniD800", None), ("g123", None), ("space", " ")])
def test_glyphs(name, want):
    assert pdf_fonts.glyph(name) == want


def test_lines_and_words():
    columns = "BT /F1 10 Tf 50 700 Td (left one) Tj 0 -12 Td (left two) Tj ET BT /F1 10 Tf 300 700 Td (right one) Tj 0 -12 Td (right two) Tj ET"
    assert read(columns) == [("left one\nleft two\nright one\nright two", "page 1")]
    rows = "BT /F1 10 Tf 50 700 Td (left) Tj 250 0 Td (right) Tj -250 -12 Td (next) Tj ET"
    assert read(rows) == [("left right\nnext", "page 1")]
    assert read("BT /F1 10 Tf 50 700 Td [(W) 80 (or) -20 (ld) -400 (two) -900 (three )] TJ (four) Tj 5 TL (five) ' ET") == [("World two three four\nfive", "page 1")]
    assert read("BT /F1 10 Tf 0 1 -1 0 50 100 Tm (up) Tj 16 0 Td (wards) Tj 0 -30 Td (x) Tj ET") == [("up wards\nx", "page 1")]
    assert read("BT /F1 10 Tf 50 700 Td (10) Tj 6 Ts (3) Tj ET BT /F1 6 Tf 64 704 Td (2) Tj ET") == [("1032", "page 1")]


def test_words_of_two_lines_are_not_one(spark):
    """Joined without a line end, the last word of one line and the first of the next would mix scripts."""
    font = "<< /Type /Font /Encoding << /Differences [65 /afii10082 /afii10074 /afii10080] >> >>"
    content = "BT /F2 12 Tf 72 700 Td (latin) Tj /F1 12 Tf 0 -14 Td (ABC) Tj ET"
    whole = document(content, "/Font << /F1 10 0 R /F2 << /Type /Font >> >>", {10: font})
    joined = document(content.replace("0 -14 Td ", ""), "/Font << /F1 10 0 R /F2 << /Type /Font >> >>", {10: font})
    rows = spark.createDataFrame([("a.pdf", ".pdf", len(d), d) for d in (whole, joined)], "source string, extension string, length long, content binary")
    found = detect.observed(reading.extract(rows), "segments", status="status").select(F.col("segments")[0]["text"].alias("t"), "o.h6").collect()
    assert {(r.t, bool(r.h6)) for r in found} == {("latin\nрио", False), ("latinрио", True)}


SPACES = "/ColorSpace << /Sep [/Separation /Spot /DeviceCMYK 9 0 R] /Icc [/ICCBased 9 0 R] /N [/DeviceN [/A /B] /DeviceRGB 9 0 R] /Grey /DeviceGray /Rgb [/DeviceRGB] >>"
SHOW = "BT /F1 12 Tf 72 700 Td (secret) Tj ET"


@pytest.mark.parametrize(
    ("content", "label", "unresolved"),
    [
        ("/Sep cs 1 scn ", None, 1), ("/Icc cs 1 1 1 sc ", None, 1), ("/N cs 0 0 scn ", None, 1), ("/Pattern cs /P scn ", None, 1), ("/Unknown cs 1 scn ", None, 1),
        ("/DeviceGray cs ", None, 0), ("/DeviceGray cs 1 sc ", "white_text", 0), ("/Grey cs 1 sc ", "white_text", 0), ("/Rgb cs 1 1 1 scn ", "white_text", 0), ("/DeviceCMYK cs 0 0 0 0 sc ", "white_text", 0),
        ("/DeviceCMYK cs ", None, 0), ("/DeviceRGB cs 1 1 sc ", None, 1), ("1 g q /Sep cs 1 scn Q ", "white_text", 0), ("/Sep cs 1 scn 1 g ", "white_text", 0), ("1 Tr 1 G ", "white_text", 0),
        ("1 Tr /DeviceGray CS 1 SC ", "white_text", 0), ("2 Tr 1 g ", None, 0), ("2 Tr 1 g /Sep CS 1 SCN ", None, 1), ("0.02 0.02 0.02 0.02 k ", "white_text", 0), ("0.97 g ", None, 0),
    ],
)
def test_colour_spaces(content, label, unresolved):
    found = pdf.pdf(document(content + SHOW, SPACES, {9: "<< /N 3 >>"}), LIMITS)
    assert [s.location for s in found] == ["page 1" if label is None else f"page 1 ({label})"]
    assert found.counts.get("color_unresolved", 0) == unresolved


@pytest.mark.parametrize(
    ("path", "visible"),
    [
        ("50 650 m 350 650 l 350 750 l 50 750 l h f", True), ("50 650 m 350 650 l 350 750 l h f*", True), ("50 650 m 50 800 350 800 350 650 c f", True), ("50 650 m 350 800 350 650 v f", True),
        ("50 650 300 100 re B", True), ("50 650 300 100 re b", True), ("50 650 300 100 re B*", False), ("50 650 300 100 re S", False), ("50 650 300 100 re W n", False), ("1 g 50 650 300 100 re f", False),
        ("q 0 1 -1 0 400 600 cm 50 50 100 350 re f Q", True), ("50 650 100 100 re 150 650 200 100 re f", True), ("70 690 20 30 re f", False),
    ],
)
def test_paint_boxes(path, visible):
    found = pdf.pdf(document(f"0 g {path} 1 g {SHOW}"), LIMITS)
    assert [s.location for s in found] == ["page 1" if visible else "page 1 (white_text)"]


def test_widths_decide_what_is_painted_over():
    narrow = "/Font << /F1 << /Type /Font /FirstChar 97 /Widths [" + "100 " * 26 + "] >> >>"
    content = "0 g 70 690 30 30 re f 1 g " + SHOW
    assert read(content, narrow) == [("secret", "page 1")]  # 6 letters of 1.2
    assert read(content) == [("secret", "page 1 (white_text)")]  # 6 letters of 12


def packed_lzw(data: bytes) -> bytes:
    """A plain encoder: codes of growing width, the table cleared when it is full."""
    out, bits, table, width = 0, 0, {bytes([i]): i for i in range(256)}, 9
    codes, w = [(256, 9)], b""
    size = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        table[w + c] = size
        size += 1
        width = min(12, size.bit_length())
        if size == 4095:
            codes.append((256, width))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = c
    codes += [(table[w], width)] if w else []
    size += 1
    codes.append((257, min(12, size.bit_length())))
    for code, n in codes:
        out, bits = out << n | code, bits + n
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


CONTENT = ("BT /F1 12 Tf 72 700 Td (through a filter) Tj ET " + "0 0 m 1 1 l n " * 900).encode()


@pytest.mark.parametrize(
    ("head", "body"),
    [
        ("/Filter /LZWDecode", packed_lzw(CONTENT)), ("/Filter /ASCII85Decode", base64.a85encode(CONTENT) + b"~>"), ("/Filter [/ASCIIHexDecode]", CONTENT.hex().encode() + b">"),
        ("/Filter /RunLengthDecode", b"".join(bytes([len(p) - 1]) + p for p in (CONTENT[i : i + 100] for i in range(0, len(CONTENT), 100))) + b"\x80"),
        ("/Filter [/A85 /Fl]", base64.a85encode(zlib.compress(CONTENT)) + b"~>"), ("/Filter /FlateDecode", zlib.compress(CONTENT)[:-3]),
        ("/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 50 >>", zlib.compress(b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)) for row, above in zip((CONTENT[i : i + 50] for i in range(0, len(CONTENT), 50)), [bytes(50), *(CONTENT[i : i + 50] for i in range(0, len(CONTENT), 50))])))),
        ("/Filter [/FlateDecode] /DecodeParms [<< /Predictor 2 /Columns 1 /Colors 1 >>]", zlib.compress(CONTENT)),
    ],
)
def test_filters(head, body):
    assert read(body, head=head) == [("through a filter", "page 1")]


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_row_filters(kind):
    """Rows undone by the filters as defined, byte by byte."""
    rows, step = [bytes((i * 7 + j * 13 + i * j) % 256 for j in range(12)) for i in range(5)], 3
    packed, above = b"", bytes(12)
    for row in rows:
        left = lambda i: row[i - step] if i >= step else 0  # noqa: B023, E731
        corner = lambda i: above[i - step] if i >= step else 0  # noqa: B023, E731

        def paeth(i):
            p = left(i) + above[i] - corner(i)  # noqa: B023
            return min((left(i), above[i], corner(i)), key=lambda v: abs(p - v))  # noqa: B023

        guess = {0: lambda i: 0, 1: left, 2: lambda i: above[i], 3: lambda i: (left(i) + above[i]) // 2, 4: paeth}[kind]  # noqa: B023
        packed += bytes([kind]) + bytes((row[i] - guess(i)) & 255 for i in range(12))
        above = row
    assert pdf_filters.unpredicted(packed, 10 + kind, 4, 3, 8) == b"".join(rows)


def test_filters_refuse():
    for name, data in (("DCTDecode", b""), ("ASCII85Decode", b"\xff"), ("LZWDecode", b"\xff\xf0\x00")):
        if name != "LZWDecode":
            with pytest.raises(ValueError):
                pdf_filters.unpack(data, name, {})
    assert read(b"x", head="/Filter /DCTDecode") == [("", "page 1 (Extraction failed)")]


def test_what_the_font_drops_is_rescued_from_the_stream():
    """Marks that no one sees, in a string whose font gives other characters for them."""
    content = b"BT /F1 12 Tf 72 700 Td (\xfe\xff\x00a\x20\x0b\x00b) Tj ET"
    font = {10: "<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [] /ToUnicode 12 0 R >>", 12: ("", b"1 beginbfrange <0000> <FFFF> <0041> endbfrange".replace(b"<0000> <FFFF> <0041>", b"<0000> <FFFF> [<0041>]") + b" 3 beginbfchar <FEFF> <0078> <0061> <0061> <200B> <0079> endbfchar")}
    found = read(content, "/Font << /F1 10 0 R >>", font)
    assert [where for _, where in found] == ["page 1", "page 1 (raw stream)"]
    assert found[1][0] == "a​b" and "​" not in found[0][0]


def test_what_findings_state():
    found, _ = pdf.audit(document("BT /F1 0.5 Tf /F1 " + "9" * 400 + " Tf 1 0 0 1 700 10.25 Tm /F1 0 Tf /F1 true Tf ET"))
    assert [pdf.stated(rule, measured) for _, _, rule, measured in found] == [("Tf font size", "0.5"), ("Tm position", "700 10.25"), ("Tf font size", "0")]
    assert pdf.compact(1e17) == "1e+17" and pdf.compact(-2.0) == "-2"


def test_pictures_are_all_listed_and_decoded_once(monkeypatch):
    head = "/Type /XObject /Subtype /Image /Width 50 /Height 50"
    objects = {n: (head, b"%d" % n) for n in range(1_000, 1_450)} | {2_000: (head, b"deep"), 2_001: (head, b"1000")}
    objects |= {n: (f"/Type /XObject /Subtype /Form /Resources << /XObject << /F {n + 1} 0 R >> >>", b"") for n in range(10, 29)} | {29: ("/Type /XObject /Subtype /Form /Resources << /XObject << /D 2000 0 R >> >>", b"")}
    objects |= {2: "<< /Type /Pages /Kids [3 0 R 3 0 R] /MediaBox [0 0 612 792] >>"}
    data = document("", "/XObject << " + " ".join(f"/I{n} {n} 0 R" for n in range(1_000, 1_450)) + " /Again 2001 0 R /F 10 0 R >>", objects)
    calls, stream = [], pdf.File.stream
    monkeypatch.setattr(pdf.File, "stream", lambda file, value: calls.append(int(value)) or stream(file, value))
    assert [(page, name) for page, name, *_ in pdf.pictures(data)] == [(1, f"/I{n}") for n in range(1_000, 1_450)] + [(1, "/D")]
    assert sorted(calls) == [*range(1_000, 1_450), 2_000, 2_001]
