"""Texts in the metadata of image files: EXIF tags and XMP packets of JPEG, PNG, TIFF, WebP and GIF.

Each container is cut in its blocks; what they hold is the same everywhere: a TIFF directory of tags, and a packet of
text.  Pictures of these formats but PNG are not decoded, so they give metadata only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from veilmark.sources.reading import Limits, Segment, register

#: EXIF tags that hold text.
TAGS = {
    270: "ImageDescription", 271: "Make", 272: "Model", 285: "PageName", 305: "Software", 315: "Artist", 33432: "Copyright",
    37510: "UserComment", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject",
}
#: How a user comment says its encoding.
COMMENT_CODES = {b"ASCII\0\0\0": "ascii", b"UNICODE\0": "utf-16-be", b"JIS\0\0\0\0\0": "shift_jis"}
SUB_DIRECTORY = 0x8769
LEAST = 10
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def directory(tiff: bytes, at: int, order: str) -> dict[int, tuple[int, bytes]]:
    """tag: (type, raw value) of one directory; entries that point outside the data are left out."""
    found: dict[int, tuple[int, bytes]] = {}
    if at + 2 > len(tiff):
        return found
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for entry in range(at + 2, min(at + 2 + 12 * n, len(tiff) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        size = _SIZES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        if size and start + size <= len(tiff):
            found[tag] = (kind, tiff[start : start + size])
    return found


def decoded(tag: int, kind: int, raw: bytes) -> str | None:
    """A tag's text, by its type and the conventions of some tags."""
    if kind == 2:
        return raw.rstrip(b"\0").decode("latin-1")
    if kind not in (1, 7):
        return None
    if 40091 <= tag <= 40095:
        return raw.decode("utf-16-le", "ignore").rstrip("\0")
    if tag == 37510 and len(raw) > 8:
        return raw[8:].decode(COMMENT_CODES.get(raw[:8], "latin-1"), "ignore")
    return raw.decode("latin-1")


def exif(tiff: bytes) -> list[Segment]:
    """The texts of the first directory, then of the one for EXIF itself."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return []
    first = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    levels = [first]
    kind, raw = first.get(SUB_DIRECTORY, (0, b""))
    if kind in (4, 9) and len(raw) == 4:
        levels.append(directory(tiff, struct.unpack(order + "I", raw)[0], order))
    found = []
    for tag, (kind, raw) in (item for level in levels for item in level.items()):
        text = (decoded(tag, kind, raw) or "").strip() if tag in TAGS else ""
        if len(text) >= LEAST:
            found.append(Segment(text, False, "metadata", f"EXIF / {TAGS[tag]} (tag {tag})"))
    return found


def packet(raw: bytes) -> list[Segment]:
    text = raw.decode("utf-8", "ignore").strip()
    return [Segment(text, False, "metadata", "XMP packet")] if len(text) >= LEAST else []


def _jpeg(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA):
            return
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            yield "exif", body[6:]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            yield "xmp", body.partition(b"\0")[2]
        at += 2 + max(2, size)


def _riff(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"EXIF":
            yield "exif", body.removeprefix(b"Exif\0\0")
        elif name == b"XMP ":
            yield "xmp", body
        at += 8 + size + size % 2


def _tiff(data: bytes) -> Iterator[tuple[str, bytes]]:
    yield "exif", data
    order = "<" if data[:2] == b"II" else ">"
    _, raw = directory(data, struct.unpack_from(order + "I", data, 4)[0], order).get(700, (0, b""))
    yield "xmp", raw


def _gif(data: bytes) -> Iterator[tuple[str, bytes]]:
    head, found, rest = data.partition(b"\x21\xff\x0bXMP DataXMP")
    if found:
        yield "xmp", rest[: rest.find(b"\x01\xff\xfe")] if b"\x01\xff\xfe" in rest else rest


def blocks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(exif or xmp, body) of what the file holds; a file of none of the formats is an error."""
    if data.startswith(b"\xff\xd8"):
        return _jpeg(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _riff(data)
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        return _tiff(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(data)
    if data.startswith(b"BM"):
        return iter(())
    raise ValueError("not an image of these formats")


def image(data: bytes, limits: Limits) -> list[Segment]:
    every = list(blocks(data))
    tags = [s for kind, body in every if kind == "exif" for s in exif(body)]
    return tags + [s for kind, body in every if kind == "xmp" for s in packet(body)][:1]


register([".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"], image)
