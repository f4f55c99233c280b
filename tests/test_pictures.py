from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from tests.test_formats import image, page
from tests.test_pdf import document, packed_lzw
from veilmark.sources import formats, pictures, pixels, reading

LIMITS = reading.Limits()
RND = np.random.default_rng(6)


def packed_gif(index: np.ndarray, palette: np.ndarray, clear: int | None = None, interlaced: bool = False) -> bytes:
    """A GIF whose codes are cleared so often that their width never grows."""
    h, w = index.shape
    if interlaced:
        index = index[np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])]
    bits = max(2, (len(palette) - 1).bit_length())
    out = n = 0
    for i, v in enumerate(index.ravel().tolist()):
        for code in ([1 << bits] if i % ((1 << bits) - 2) == 0 else []) + [v]:
            out, n = out | code << n, n + bits + 1
    out, n = out | ((1 << bits) + 1) << n, n + bits + 1
    body = out.to_bytes((n + 7) // 8, "little")
    parts = b"".join(bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)) + b"\0"
    control = b"\x21\xf9\x04" + bytes([clear is not None, 0, 0, clear or 0]) + b"\0"
    table = palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0")
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | bits - 1, 0, 0) + table + control + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x40 if interlaced else 0) + bytes([bits]) + parts + b"\x3b"


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif(interlaced):
    index, palette = RND.integers(0, 16, (23, 37)), RND.integers(0, 256, (16, 3))
    got = pixels.gif(packed_gif(index, palette, 3, interlaced))
    assert (got[:, :, :3] == palette[index]).all() and ((got[:, :, 3] == 0) == (index == 3)).all()
    clear = packed_gif(np.zeros((40, 60), int), np.array([[200, 0, 0], [0, 0, 0]]), 0)
    assert [(s.kind, s.location) for s in pictures.file()(clear, LIMITS)] == [("css_hidden", "first hit at (0, 0)")]


def test_gif_codes_grow():
    """Codes of growing width, up to twelve bits, as an encoder makes them."""
    data = RND.integers(0, 4, 60_000).astype(np.uint8).tobytes()
    out = n = 0
    table, width, size, w = {bytes([i]): i for i in range(4)}, 3, 6, b""
    codes = [(4, 3)]
    for c in (data[i : i + 1] for i in range(len(data))):
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        if size < 4096:
            table[w + c] = size
            if size == 1 << width and width < 12:
                width += 1
            size += 1
        w = c
    codes += [(table[w], width), (5, width)]
    for code, bits in codes:
        out, n = out | code << n, n + bits
    assert pixels.lzw(out.to_bytes((n + 7) // 8, "little"), 2, len(data)) == data


def made_bmp(rows: np.ndarray, bits: int, palette: np.ndarray | None = None, down: bool = False) -> bytes:
    h, w = rows.shape[:2]
    lines = []
    for line in rows if down else rows[::-1]:
        if bits == 8:
            raw = line.astype(np.uint8).tobytes()
        elif bits < 8:
            raw = np.packbits(((line[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()).tobytes()
        else:
            raw = line[:, [2, 1, 0, 3][: bits // 8]].astype(np.uint8).tobytes()
        lines.append(raw + b"\0" * (-len(raw) % 4))
    table = b"" if palette is None else np.c_[palette[:, ::-1], np.zeros(len(palette))].astype(np.uint8).tobytes()
    body = b"".join(lines)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, w, -h if down else h, 1, bits, 0, len(body), 0, 0, 0 if palette is None else len(palette), 0) + table + body


@pytest.mark.parametrize(("bits", "down"), [(1, False), (4, False), (8, True), (24, False), (32, True)])
def test_bmp(bits, down):
    if bits <= 8:
        palette, index = RND.integers(0, 256, (1 << bits, 3)), RND.integers(0, 1 << bits, (9, 13))
        got = pixels.bmp(made_bmp(index, bits, palette, down))
        assert (got[:, :, :3] == palette[index]).all() and (got[:, :, 3] == 255).all()
    else:
        rows = RND.integers(0, 256, (9, 13, 4))
        got = pixels.bmp(made_bmp(rows, bits, None, down))
        assert (got[:, :, :3] == rows[:, :, :3]).all() and (got[:, :, 3] == 255).all()  # the fourth byte is not used without masks


def made_tiff(rows: np.ndarray, packed: int, photometric: int, order: str = "<", strips: int = 4, predictor: int = 1, palette: np.ndarray | None = None) -> bytes:
    h, w, n = rows.shape
    pack = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[i : i + 100]) - 1]) + b[i : i + 100] for i in range(0, len(b), 100))}[packed]
    data, places, sizes = b"", [], []
    for at in range(0, h, strips):
        part = rows[at : at + strips].astype(np.int64)
        if predictor == 2:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1) & 255
        raw = pack(part.astype(np.uint8).tobytes())
        places.append(8 + len(data))
        sizes.append(len(raw))
        data += raw
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * n), (259, 3, [packed]), (262, 3, [photometric]), (273, 4, places), (277, 3, [n]), (278, 4, [strips]), (279, 4, sizes), (317, 3, [predictor])]
    tags += [(320, 3, (palette.T.ravel() * 257).tolist())] if palette is not None else []
    start = 8 + len(data)
    body, extra = struct.pack(order + "H", len(tags)), b""
    for tag, kind, values in tags:
        raw = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + 2 + 12 * len(tags) + 4 + len(extra))
        extra += raw if len(raw) > 4 else b""
        body += struct.pack(order + "HHI", tag, kind, len(values)) + place
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", start) + data + body + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize(("packed", "n", "order", "predictor"), [(1, 3, "<", 1), (5, 3, ">", 2), (8, 4, "<", 2), (32773, 1, "<", 1), (5, 1, "<", 1), (8, 3, ">", 1)])
def test_tiff(packed, n, order, predictor):
    rows = RND.integers(0, 256, (10, 17, n))
    got = pixels.tiff(made_tiff(rows, packed, 2 if n >= 3 else 1, order, predictor=predictor))
    assert (got[:, :, :3] == (rows[:, :, :3] if n >= 3 else rows[:, :, :1])).all() and (got[:, :, 3] == (rows[:, :, 3] if n == 4 else 255)).all()
    palette, index = RND.integers(0, 256, (256, 3)), RND.integers(0, 256, (6, 5, 1))
    assert (pixels.tiff(made_tiff(index, packed, 3, order, palette=palette))[:, :, :3] == palette[index[:, :, 0]]).all()


def test_layers_of_other_formats():
    faint = np.full((50, 50, 4), 255)
    faint[10:20, :, :3] = (240 - np.arange(50) % 10)[None, :, None]
    for made in (made_bmp(faint, 24), made_tiff(faint[:, :, :3], 8, 2)):
        assert [s.text[:12] for s in pictures.file()(made, LIMITS)] == ["low contrast"]
    for broken in (b"BM" + b"\0" * 60, b"GIF89a" + b"\xff" * 20, made_bmp(faint, 24)[:60]):
        assert isinstance(pictures.file()(broken, LIMITS), list)


def test_languages():
    assert pictures.languages("eng+jpn_vert") == "eng+jpn_vert"
    for bad in ("", "eng+", "../x", "eng jpn", "-c", None):
        with pytest.raises(ValueError):
            pictures.languages(bad)


def illustrated(kinds: list[str]) -> bytes:
    grey, clear = bytes([90]) * 2500, bytes([200, 10, 10]) * 3600
    objects = {
        10: ("/Type /XObject /Subtype /Image /Width 50 /Height 50 /ColorSpace /DeviceGray /BitsPerComponent 8", grey), 11: ("/Type /XObject /Subtype /Image /Width 60 /Height 60 /ColorSpace /DeviceRGB /BitsPerComponent 8 /SMask 12 0 R", clear),
        12: ("/Type /XObject /Subtype /Image /Width 60 /Height 60 /ColorSpace /DeviceGray /BitsPerComponent 8", bytes(3600)), 13: ("/Type /XObject /Subtype /Image /Width 49 /Height 90 /ColorSpace /DeviceGray", bytes(4410)),
        14: ("/Type /XObject /Subtype /Image /Width 70 /Height 70 /Filter /DCTDecode", b"\xff\xd8\xff\xe1" + struct.pack(">H", 42) + b"http://ns.adobe.com/xap/1.0/\0packet text\xff\xda"),
        15: ("/Type /XObject /Subtype /Image /Width 50 /Height 50 /ColorSpace [/Indexed /DeviceRGB 1 <5A5A5A000000>] /BitsPerComponent 8", bytes(2500)),
    }
    names = {"grey": 10, "clear": 11, "small": 13, "jpeg": 14, "same": 15}
    return document("BT /F1 12 Tf 72 700 Td (text) Tj ET", "/XObject << " + " ".join(f"/{k} {names[k]} 0 R" for k in kinds) + " >>", objects)


def test_combined_pdf():
    calls = []

    def recogniser(every, said):
        calls.append((len(every), said))
        if any(p.rgba is None for p in every):
            raise RuntimeError("no pixels")
        return [f"{p.width} wide" for p in every]

    data = illustrated(["grey", "small", "clear", "jpeg", "same"])
    found = pictures.combined(recogniser, "eng+deu")(data, LIMITS)
    assert [(s.kind, s.text[:17], s.location) for s in found] == [
        ("body", "text", "page 1"), ("body", "50 wide", "page 1, image #1 (50x50) [OCR]"), ("css_hidden", "transparent layer", "page 1, image #3 (60x60) [first hit at (0, 0)]"), ("body", "60 wide", "page 1, image #3 (60x60) [OCR]"),
        ("metadata", "packet text", "page 1, image #4 (70x70) [XMP packet]"),
    ]
    assert calls[0] == (3, "eng+deu") and len(calls) == 4  # all at once, then each, since one failed
    assert [s.text for s in pictures.combined()(illustrated(["grey"]), LIMITS)] == ["text"]
    with pytest.raises(ValueError):
        pictures.combined(recogniser)(b"not a PDF", LIMITS)
    counts = pictures.combined()(page("0 g 50 650 300 100 re f 1 g BT /F1 12 Tf 72 700 Td (x) Tj ET"), LIMITS).counts
    assert counts == {"white_on_painted": 1}


def test_a_recogniser_is_plugged_in(spark):
    plain = image(np.full((50, 60, 3), 255, np.uint8), 2)
    pictures.install(lambda every, said: [f"Pаypаl {said} {p.width}" for p in every], "deu")
    try:
        rows = spark.createDataFrame([("a.png", ".png", len(plain), plain), ("b.bmp", ".bmp", 10, made_bmp(np.zeros((4, 70, 4), int), 24))], "source string, extension string, length long, content binary")
        found = {r.source: [(s.text, s.location, s.visible) for s in r.segments] for r in reading.extract(rows).collect()}
        assert found == {"a.png": [("Pаypаl deu 60", "OCR", True)], "b.bmp": [("Pаypаl deu 70", "OCR", True)]}
    finally:
        formats.install()
