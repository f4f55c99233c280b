"""Fonts of PDF, as far as text needs them: which characters a string's codes mean, and how wide they are.

A font says what its codes mean in a ToUnicode map, an encoding with differences, or, for composite fonts, by a map from codes
to glyphs with a known character set.  Codes that nothing explains are taken as Latin-1 (one byte) or as the character of
their number (two bytes).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from typing import Any

from veilmark.sources.pdf_syntax import File, Name, Word, said, tokens

#: Names of glyphs that no rule below gives.
GLYPHS = dict(
    pair.split("=", 1)
    for pair in (
        "space=\x20 exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/"
        " zero=0 one=1 two=2 three=3 four=4 five=5 six=6 seven=7 eight=8 nine=9 colon=: semicolon=; less=< equal== greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=]"
        " asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ exclamdown=¡ cent=¢ sterling=£ currency=¤ yen=¥ brokenbar=¦ section=§ dieresis=¨ copyright=© ordfeminine=ª"
        " guillemotleft=« logicalnot=¬ registered=® macron=¯ degree=° plusminus=± acute=´ mu=µ paragraph=¶ periodcentered=· cedilla=¸ ordmasculine=º guillemotright=» onequarter=¼ onehalf=½"
        " threequarters=¾ questiondown=¿ AE=Æ ae=æ Oslash=Ø oslash=ø germandbls=ß multiply=× divide=÷ Eth=Ð eth=ð Thorn=Þ thorn=þ dotlessi=ı Lslash=Ł lslash=ł OE=Œ oe=œ florin=ƒ circumflex=ˆ"
        " caron=ˇ breve=˘ dotaccent=˙ ring=˚ ogonek=˛ tilde=˜ hungarumlaut=˝ endash=– emdash=— quoteleft=‘ quoteright=’ quotesinglbase=‚ quotedblleft=“ quotedblright=” quotedblbase=„ dagger=†"
        " daggerdbl=‡ bullet=• ellipsis=… perthousand=‰ guilsinglleft=‹ guilsinglright=› fraction=⁄ Euro=€ trademark=™ minus=− fi=fi fl=fl ff=ff ffi=ffi ffl=ffl nbspace=\xa0 sfthyphen=\xad"
    ).split(" ")
    if "=" in pair
)
GLYPHS["space"] = " "
#: Accents as names of glyphs end in them.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̧"}
#: Encodings by name, and what the standard one has other than Latin-1.
ENCODINGS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
#: Character sets of predefined maps, by how their names begin.
CHARACTER_SETS = (("Identity", "utf-16-be"), ("UniGB-UTF", "utf-16-be"), ("Uni", "utf-16-be"), ("GBK", "gbk"), ("GB", "gb2312"), ("90ms", "cp932"), ("90pv", "cp932"), ("83pv", "cp932"), ("EUC", "euc_jp"), ("ETen", "cp950"), ("B5", "big5"), ("HKscs", "big5hkscs"), ("KSCms", "cp949"), ("KSC", "euc_kr"))


def glyph(name: str) -> str | None:
    """The characters of a glyph's name: listed, one letter, by code, letters with accents, Greek and Cyrillic names."""
    name = name.partition(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if "_" in name:
        parts = [glyph(p) for p in name.split("_")]
        return "".join(p for p in parts if p) if all(parts) else None
    coded = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name)
    if coded:
        numbers = [int(coded[1][i : i + 4], 16) for i in range(0, len(coded[1]), 4)] if coded[1] else [int(coded[2], 16)]
        return "".join(chr(n) for n in numbers) if all(n < 0x110000 and not 0xD800 <= n < 0xE000 for n in numbers) else None
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1 and name[0].isascii() and name[0].isalpha():
            whole = unicodedata.normalize("NFC", name[0] + mark)
            return whole if len(whole) == 1 else None
    cyrillic = re.fullmatch(r"afii(10\d{3})", name)
    if cyrillic:
        n = int(cyrillic[1])
        for first, to, yo in ((10017, 0x410, 10023), (10065, 0x430, 10071)):
            if first <= n <= first + 32:
                return chr(to - 0x0F if to == 0x410 else to + 0x21) if n == yo else chr(to + n - first - (n > yo))
    try:
        kind = "CAPITAL" if name[0].isupper() else "SMALL"
        return unicodedata.lookup(f"GREEK {kind} LETTER {name.upper()}")
    except KeyError:
        return None


class Codes:
    """A map from codes to characters or glyphs, and how many bytes codes have."""

    def __init__(self, data: bytes) -> None:
        self.single: dict[int, Any] = {}
        self.ranges: list[tuple[int, int, Any]] = []
        self.spaces: list[tuple[int, int, int]] = []
        held: list[Any] = []
        for token in tokens(data):
            if not isinstance(token, Word):
                held.append(token)
                continue
            if token == "endcodespacerange":
                self.spaces += [(len(a), int.from_bytes(a), int.from_bytes(b)) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif token in ("endbfchar", "endcidchar"):
                self.single |= {int.from_bytes(a): b for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes)}
            elif token in ("endbfrange", "endcidrange"):
                for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    low, high = int.from_bytes(a), int.from_bytes(b)
                    if isinstance(to, list):
                        self.single |= {low + i: t for i, t in enumerate(to[: high - low + 1])}
                    else:
                        self.ranges.append((low, high, to))
            held = []
        self.ranges.sort(key=lambda r: r[:2])
        self.starts = [r[0] for r in self.ranges]

    def found(self, code: int) -> tuple[Any, int]:
        """(what the map says of the code, how far the code lies behind what it says)."""
        if code in self.single:
            return self.single[code], 0
        at = bisect_right(self.starts, code) - 1
        if at >= 0 and code <= self.ranges[at][1]:
            return self.ranges[at][2], code - self.ranges[at][0]
        return None, 0

    def text(self, code: int) -> str | None:
        to, beyond = self.found(code)
        if isinstance(to, Name):
            return glyph(to)
        if not isinstance(to, bytes) or not to:
            return None
        plain = to.decode("utf-16-be", "replace") if len(to) > 1 else to.decode("latin-1")
        return plain[:-1] + chr(min(ord(plain[-1]) + beyond, 0x10FFFF)) if beyond else plain

    def number(self, code: int) -> int | None:
        to, beyond = self.found(code)
        return to + beyond if isinstance(to, int) else None

    def split(self, raw: bytes) -> list[tuple[int, int]]:
        """(code, bytes of it) of a string, by the code spaces; two bytes where none fits."""
        sizes = sorted({n for n, _, _ in self.spaces}) or [2]
        out, at = [], 0
        while at < len(raw):
            for n in sizes:
                code = int.from_bytes(raw[at : at + n])
                if any(n == m and low <= code <= high for m, low, high in self.spaces):
                    break
            else:
                n = sizes[-1] if not self.spaces else sizes[0]
                code = int.from_bytes(raw[at : at + n])
            out.append((code, n))
            at += n
        return out


def usual_width(text: str) -> float:
    """About how wide characters are in a font that does not say, in units of its size."""
    return sum(0.28 if c in "ijltfrI.,:;'|!()[] " else 0.85 if c in "mwMW@%" else 1.0 if ord(c) > 0x2E80 else 0.67 if c.isupper() else 0.53 for c in text)


class Font:
    """``read`` gives a string's characters, about how wide they are in units of the size, and at most how wide.

    At most: characters whose width the font does not say count as one size.
    """

    def __init__(self, file: File, value: Any) -> None:
        own = file.get(value)
        own = own if isinstance(own, dict) else {}
        self.composite = own.get("Subtype") == "Type0"
        self.to_unicode = self._codes(file, own.get("ToUnicode"))
        self.codec, self.table, self.codes = None, None, None
        self.widths: dict[int, float] = {}
        self.missing: float | None = None
        if self.composite:
            self._composite(file, own)
        else:
            self._simple(file, own)

    @staticmethod
    def _codes(file: File, value: Any) -> Codes | None:
        try:
            data = file.stream(value) if value is not None else b""
        except (ValueError, RecursionError):
            return None
        return Codes(data) if data else None

    def _simple(self, file: File, own: dict) -> None:
        encoding = file.get(own.get("Encoding"))
        base = encoding if isinstance(encoding, str) else file.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else None
        plain = bytes(range(256)).decode(ENCODINGS.get(str(base), "latin-1"), "replace")
        table = [c if c != "�" else chr(i) for i, c in enumerate(plain)]
        if isinstance(encoding, dict):
            at = 0
            for item in file.get(encoding.get("Differences"), []):
                item = file.get(item)
                if isinstance(item, Name):
                    if 0 <= at < 256:
                        table[at] = glyph(item) or table[at]
                    at += 1
                elif isinstance(item, int):
                    at = item
        self.table = table
        first, widths = file.get(own.get("FirstChar"), 0), file.get(own.get("Widths"))
        if isinstance(widths, list) and isinstance(first, int):
            self.widths = {first + i: float(w) / 1000 for i, w in enumerate(map(file.get, widths)) if isinstance(w, (int, float))}

    def _composite(self, file: File, own: dict) -> None:
        encoding = file.get(own.get("Encoding"))
        if isinstance(encoding, Name):
            self.codec = next((codec for start, codec in CHARACTER_SETS if encoding.startswith(start)), "utf-16-be")
        else:
            self.codes = self._codes(file, own.get("Encoding"))
        below = file.get(own.get("DescendantFonts"), [])
        below = file.get(below[0], {}) if isinstance(below, list) and below else {}
        whole = file.get(below.get("DW"), 1000)
        self.missing = float(whole) / 1000 if isinstance(whole, (int, float)) else 1.0
        items = [file.get(x) for x in file.get(below.get("W"), [])]
        at = 0
        while at + 1 < len(items):
            if isinstance(items[at + 1], list):
                self.widths |= {items[at] + i: float(w) / 1000 for i, w in enumerate(map(file.get, items[at + 1])) if isinstance(w, (int, float))}
                at += 2
            elif at + 2 < len(items) and isinstance(items[at + 2], (int, float)):
                for code in range(items[at], min(items[at + 1], items[at] + 65535) + 1):
                    self.widths[code] = float(items[at + 2]) / 1000
                at += 3
            else:
                break

    def read(self, raw: bytes) -> tuple[str, float, float]:
        if self.composite:
            return self._wide(raw)
        if raw.startswith(b"\xfe\xff"):
            text = said(raw)
            return text, usual_width(text), float(len(text))
        text, width, most = [], 0.0, 0.0
        for code in raw:
            c = (self.to_unicode and self.to_unicode.text(code)) or self.table[code]
            text.append(c)
            w = self.widths.get(code)
            width += usual_width(c) if w is None else w
            most += 1.0 if w is None else w
        return "".join(text), width, most

    def _wide(self, raw: bytes) -> tuple[str, float, float]:
        map_ = self.codes or (self.to_unicode if self.codec is None else None)
        codes = map_.split(raw) if map_ is not None else [(int.from_bytes(raw[i : i + 2]), 2) for i in range(0, len(raw), 2)]
        if self.codec not in (None, "utf-16-be") and self.to_unicode is None:
            text = raw.decode(self.codec, "replace")
            return text, float(len(text)), float(len(text))
        text, width = [], 0.0
        for code, _ in codes:
            c = self.to_unicode.text(code) if self.to_unicode is not None else None
            if c is None:
                c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
            text.append(c)
            glyph_ = self.codes.number(code) if self.codes is not None else code
            width += self.widths.get(code if glyph_ is None else glyph_, self.missing)
        return "".join(text), width, width
