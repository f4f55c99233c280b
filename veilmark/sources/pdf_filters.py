"""The stream filters of PDF: Flate, LZW, ASCII85, ASCIIHex, RunLength, and the predictors of the first two."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: A stream may unpack to so many bytes; one that would give more is refused.
MOST = 256 << 20


def flate(data: bytes) -> bytes:
    """What can be had of it: a broken tail, a wrong checksum or bytes that follow don't matter."""
    done = zlib.decompressobj()
    out = bytearray()
    for at in range(0, len(data), 1 << 16):
        try:
            out += done.decompress(data[at : at + (1 << 16)], MOST - len(out) + 1)
        except zlib.error:
            if not out:
                raise
            break
        if len(out) > MOST:
            raise ValueError("too large")
        if done.eof:
            break
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends.  ``early``: widths grow one code before they have to."""
    out, held, bits = bytearray(), 0, 0
    table: list[bytes] = []
    width, before = 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            if code == 256:
                continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("lzw")
        out += entry
        if len(out) > MOST:
            raise ValueError("too large")
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    """Five characters for four bytes, ``z`` for four zeros, up to ``~>``; a last group may be shorter."""
    body = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data).partition(b"~")[0].removeprefix(b"<")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += (_base85(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise ValueError("ascii85")
    if group:
        missing = 5 - len(group)
        out += (_base85(group + [84] * missing) & 0xFFFFFFFF).to_bytes(4, "big")[: 4 - missing]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    n = 0
    for d in digits:
        n = n * 85 + d
    return n


def asciihex(data: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data).partition(b">")[0]
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def runlength(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        if len(out) > MOST:
            raise ValueError("too large")
    return bytes(out)


def unpredicted(data: bytes, predictor: int, columns: int, colours: int, bits: int) -> bytes:
    """Samples from differences: 2, from the sample to the left; 10 and more, a filter of its own for each row."""
    if predictor < 2:
        return data
    step = max(1, colours * bits // 8)
    row = -(-columns * colours * bits // 8)
    if row <= 0:
        raise ValueError("predictor")
    if predictor == 2:
        if bits != 8:
            raise ValueError("predictor")
        whole = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colours)
        return np.cumsum(whole, axis=1, dtype=np.uint8).tobytes()
    out, above = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data), row + 1):
        line = np.zeros(row, np.uint8)
        have = np.frombuffer(data[at + 1 : at + 1 + row], np.uint8)
        line[: len(have)] = have
        above = _row(data[at], line, above, step)
        out += above[: len(have)].tobytes()
    return bytes(out)


def _row(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row of differences to its left (1), above (2), their mean (3) or the nearest of three neighbours (4)."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        full = np.zeros(-(-len(line) // step) * step, np.uint8)
        full[: len(line)] = line
        return np.cumsum(full.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (3, 4):
        raise ValueError("predictor")
    done, up = line.tolist(), above.tolist()
    for i in range(len(done)):
        left = done[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            whole = left + up[i] - corner
            guess = min((abs(whole - left), 0, left), (abs(whole - up[i]), 1, up[i]), (abs(whole - corner), 2, corner))[2]
        done[i] = done[i] + guess & 255
    return np.array(done, np.uint8)


#: The filters' names and their short forms.
NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode"}


def unpack(data: bytes, name: str, parameters: dict) -> bytes:
    """data through one filter; ValueError or zlib.error for what can't be had."""
    name = NAMES.get(name, name)
    number = lambda key, other: parameters[key] if isinstance(parameters.get(key), int) and parameters[key] > 0 else other
    if name in ("FlateDecode", "LZWDecode"):
        early = parameters.get("EarlyChange")
        raw = flate(data) if name == "FlateDecode" else lzw(data, early if isinstance(early, int) else 1)
        return unpredicted(raw, number("Predictor", 1), number("Columns", 1), number("Colors", 1), number("BitsPerComponent", 8))
    plain = {"ASCII85Decode": ascii85, "ASCIIHexDecode": asciihex, "RunLengthDecode": runlength}.get(name)
    if plain is None:
        raise ValueError("filter")
    return plain(data)
