"""PNG images: EXIF tags, text chunks, transparent layers that hold a picture, and text of too little contrast.

Eight-bit images without interlacing are decoded, with the standard library and numpy; others give their text chunks
only.  Recognising text in pictures needs libraries that are not assumed here.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

from veilmark.sources.metadata import exif
from veilmark.sources.reading import Limits, Segment, register

KEYS = ("Description", "Author", "Comment", "Copyright", "Title", "Software", "Disclaimer", "Warning")
XMP = "XML:com.adobe.xmp"
LEAST = 10
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        raise ValueError("not a PNG")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def texts(parts: list[tuple[bytes, bytes]]) -> dict[str, str]:
    found = {}
    for kind, body in parts:
        key, _, rest = body.partition(b"\0")
        if kind == b"tEXt":
            found[key.decode("latin-1")] = rest.decode("latin-1")
        elif kind == b"zTXt":
            found[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
        elif kind == b"iTXt" and len(rest) > 2:
            text = rest[2:].split(b"\0", 2)[-1]
            found[key.decode("latin-1")] = (zlib.decompress(text) if rest[0] else text).decode("utf-8", "replace")
    return found


def pixels(parts: list[tuple[bytes, bytes]]) -> np.ndarray | None:
    """Rows of RGBA; None for what isn't decoded here."""
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced or colour not in _CHANNELS:
        return None
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height, width, n), np.uint8)
    above = np.zeros((width, n), np.int64)
    for y in range(height):
        line, kind = raw[y, 1:].reshape(width, n).astype(np.int64), raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    estimate = left + up - corner
                    a, b, c = abs(estimate - left), abs(estimate - up), abs(estimate - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], up
        rows[y] = above = line
    alpha = np.full((height, width, 1), 255, np.uint8)
    found = dict(parts)
    if colour == 3:
        palette = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(found[b"PLTE"], np.uint8).reshape(-1, 3)
        palette[:, 3] = 255
        palette[: len(colours), :3] = colours
        clear = np.frombuffer(found.get(b"tRNS", b""), np.uint8)
        palette[: len(clear), 3] = clear
        return palette[rows[:, :, 0]]
    if colour in (0, 4):
        return np.concatenate([np.repeat(rows[:, :, :1], 3, axis=2), rows[:, :, 1:] if colour == 4 else alpha], axis=2)
    return rows if colour == 6 else np.concatenate([rows, alpha], axis=2)


def luminance(level: int) -> float:
    c = level / 255
    return c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4


def transparent(rgba: np.ndarray, least: int = 100, share: float = 0.005) -> Segment | None:
    lost = (rgba[:, :, 3] == 0) & (rgba[:, :, :3].max(axis=2) > 0)
    n, total = int(lost.sum()), lost.size
    if n < least or n / total < share:
        return None
    ys, xs = np.nonzero(lost)
    return Segment(f"transparent layer: {n} pixels ({round(n / total * 100, 2)}% of image) with alpha=0 and non-zero RGB", False, "css_hidden", f"first hit at ({xs.min()}, {ys.min()})")


def low_contrast(rgba: np.ndarray) -> Segment | None:
    red, green, blue = (rgba[:, :, c].astype(np.int64) for c in range(3))
    grey = (19595 * red + 38470 * green + 7471 * blue + 0x8000) >> 16
    counts = np.bincount(grey.ravel(), minlength=256)
    total, back = grey.size, int(counts.argmax())
    other = np.abs(np.arange(256) - back) >= 5
    n, levels = int(counts[other].sum()), int((counts[other] > 0).sum())
    if not total or counts[back] / total < 0.30 or n == 0 or n / total < 0.01 or levels < 8:
        return None
    mean = float((counts * np.arange(256))[other].sum()) / n
    a, b = luminance(back), luminance(int(round(mean)))
    contrast = (max(a, b) + 0.05) / (min(a, b) + 0.05)
    if contrast >= 2.0:
        return None
    said = f"low contrast: WCAG ratio {round(contrast, 2)}:1 (background={back}, foreground_mean={round(mean, 1)}, region_ratio={round(n / total, 3)}, region_unique={levels})"
    return Segment(said, False, "css_hidden", f"grayscale analysis ({rgba.shape[1]}x{rgba.shape[0]})")


def tagged(data: bytes) -> list[Segment]:
    """EXIF tags, text chunks and the XMP packet."""
    parts = list(chunks(data))
    own = texts(parts)
    tags = [s for kind, body in parts if kind == b"eXIf" for s in exif(body)]
    found = tags + [Segment(own[k].strip(), False, "metadata", f"PNG tEXt / {k}") for k in KEYS if len(own.get(k, "").strip()) >= LEAST]
    if len(own.get(XMP, "").strip()) >= LEAST:
        found.append(Segment(own[XMP].strip(), False, "metadata", "XMP packet"))
    return found


def png(data: bytes, limits: Limits) -> list[Segment]:
    rgba = pixels(list(chunks(data)))
    return tagged(data) + ([s for s in (transparent(rgba), low_contrast(rgba)) if s] if rgba is not None and rgba.size else [])


register(".png", png)
