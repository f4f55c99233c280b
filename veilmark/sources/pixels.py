"""Pixels of GIF, BMP and TIFF files as rows of RGBA, with numpy; what isn't decoded here gives None.

GIF: the first frame, interlaced or not, on an empty screen.  BMP: 1 to 32 bits a pixel without compression, with palettes and masks.
TIFF: the first page in strips, grey, palette, RGB or RGBA of 8 bits, plain or packed by LZW, Deflate or PackBits, with
predictor 2.  A picture of more than ``MOST`` pixels is not decoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from veilmark.sources import pdf_filters, png
from veilmark.sources.metadata import directory

MOST = 1 << 26


def _sized(width: int, height: int) -> bool:
    return 0 < width and 0 < height and width * height <= MOST


def lzw(data: bytes, least: int, most: int) -> bytes:
    """GIF's codes: from the low bits up, 4096 at most; the two after the colours clear the table and end it."""
    clear = 1 << least
    table: list[bytes] = []
    out, width, before = bytearray(), least + 1, b""
    held = bits = 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (1 << width) - 1
            held >>= width
            bits -= width
            if code == clear:
                table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == clear + 1 or len(out) >= most:
                return bytes(out[:most])
            if code < len(table):
                entry = table[code]
            elif before and code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("lzw")
            out += entry
            if before and len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = entry
    return bytes(out[:most])


def gif(data: bytes) -> np.ndarray | None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if not _sized(width, height):
        return None
    at = 13
    palette = np.zeros((256, 4), np.uint8)
    palette[:, 3] = 255

    def colours(at: int, n: int) -> int:
        palette[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        return at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return bytes(out), at + 1

    if flags & 0x80:
        at = colours(at, 2 << (flags & 7))
    clear: int | None = None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                clear = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("gif")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if own & 0x80:
            at = colours(at, 2 << (own & 7))
        least = data[at]
        body, at = blocks(at + 1)
        index = np.frombuffer(lzw(body, least, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if own & 0x40:
            order = np.concatenate([np.arange(first, h, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(order, kind="stable")]
        if clear is not None:
            palette[clear, 3] = 0
        out = np.zeros((height, width, 4), np.uint8)
        part = palette[index][: max(0, height - top), : max(0, width - left)]
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
        return out
    return None


def bmp(data: bytes) -> np.ndarray | None:
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, head = struct.unpack_from("<II", data, 10)
    if head < 40:
        return None
    width, height, _, bits, packed, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
    rows, down = abs(height), height < 0
    if not _sized(width, rows) or packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        return None
    step = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data[start : start + step * rows].ljust(step * rows, b"\0"), np.uint8).reshape(rows, step)
    out = np.full((rows, width, 4), 255, np.uint8)
    if bits <= 8:
        n = used or 1 << bits
        palette = np.zeros((256, 3), np.uint8)
        table = np.frombuffer(data, np.uint8, 4 * min(n, 256), 14 + head).reshape(-1, 4)
        palette[: len(table)] = table[:, 2::-1]
        index = raw if bits == 8 else (np.repeat(raw, 8 // bits, axis=1) >> np.tile(np.arange(8 - bits, -1, -bits), step)) & (1 << bits) - 1
        out[:, :, :3] = palette[index[:, :width]]
    elif bits == 24:
        out[:, :, :3] = raw[:, : 3 * width].reshape(rows, width, 3)[:, :, ::-1]
    else:
        pixels = raw[:, : 4 * width].reshape(rows, width, 4)
        masks = struct.unpack_from("<IIII", data, 54) if packed == 3 else (0xFF0000, 0xFF00, 0xFF, 0)
        if any(m and (m & 0xFF) not in (0, 0xFF) for m in masks):
            return None
        places = [(m & -m).bit_length() // 8 if m else None for m in masks]
        for c, place in enumerate(places if head >= 56 or packed == 0 else places[:3]):
            if place is not None:
                out[:, :, c] = pixels[:, :, place]
    return out if down else out[::-1]


def _unpacked(data: bytes) -> bytes:
    """PackBits."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def tiff(data: bytes) -> np.ndarray | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    tags = directory(data, struct.unpack_from(order + "I", data, 4)[0], order)

    def numbers(tag: int, other: tuple[int, ...] = ()) -> tuple[int, ...]:
        kind, raw = tags.get(tag, (0, b""))
        size = {1: "B", 3: "H", 4: "I"}.get(kind)
        return struct.unpack(f"{order}{len(raw) // struct.calcsize(size)}{size}", raw) if size and raw else other

    (width,), (height,) = numbers(256, (0,)), numbers(257, (0,))
    packed, photometric, samples = numbers(259, (1,))[0], numbers(262, (1,))[0], numbers(277, (1,))[0]
    if not _sized(width, height) or set(numbers(258, (1,))) != {8} or numbers(284, (1,))[0] != 1 or packed not in (1, 5, 8, 32946, 32773) or photometric not in (0, 1, 2, 3) or not numbers(273):
        return None
    rows, done = numbers(278, (height,))[0], []
    for i, (at, size) in enumerate(zip(numbers(273), numbers(279))):
        n = min(rows, height - i * rows) * width * samples
        strip = data[at : at + size]
        strip = pdf_filters.lzw(strip) if packed == 5 else zlib.decompress(strip) if packed in (8, 32946) else _unpacked(strip) if packed == 32773 else strip
        strip = strip[:n].ljust(n, b"\0")
        done.append(pdf_filters.unpredicted(strip, 2, width, samples, 8) if numbers(317, (1,))[0] == 2 else strip)
    every = np.frombuffer(b"".join(done)[: height * width * samples].ljust(height * width * samples, b"\0"), np.uint8).reshape(height, width, samples)
    out = np.full((height, width, 4), 255, np.uint8)
    if photometric == 3:
        table = np.array(numbers(320), np.int64).reshape(3, -1) >> 8
        out[:, :, :3] = table.T[every[:, :, 0]]
    elif photometric == 2 and samples >= 3:
        out[:, :, :3] = every[:, :, :3]
    else:
        out[:, :, :3] = (every if photometric else 255 - every)[:, :, :1]
    if samples in (2, 4) and photometric != 3:
        out[:, :, 3] = every[:, :, -1]
    return out


def rgba(data: bytes) -> np.ndarray | None:
    """A file's pixels by what it begins with; None where they are not decoded here."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return png.pixels(list(png.chunks(data)))
    for start, read in ((b"GIF8", gif), (b"BM", bmp), (b"II*\0", tiff), (b"MM\0*", tiff)):
        if data.startswith(start):
            return read(data)
    return None
