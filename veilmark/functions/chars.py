"""Character sets, as regular-expression classes that Java and RE2 both understand.

Positions and lengths are in code points throughout.
"""

from __future__ import annotations

# Code points and ranges, in hexadecimal.
WHITE_SPACE = "9-D 1C-20 85 A0 1680 2000-200A 2028 2029 202F 205F 3000"
ZERO_WIDTH = "200B-200D 2060 FEFF"
BIDI = "202A-202E 2066-2069"
TAG = "E0000-E007F"
VARIATION = "FE00-FE0F E0100-E01EF"
CONTROL = "0-8 B C E-1F"
LATIN = (
    "41-5A 61-7A C0-D6 D8-F6 F8-2AF 1D00-1D25 1D62-1D65 1D6B-1D77 1D79-1D9A 1E00-1EFF 2090-209C 2184 271D 2C60-2C7C "
    "2C7E-2C7F A722-A76F A771-A787 A78B-A7CA A7D0-A7D1 A7D3 A7D5-A7D9 A7F5-A7F7 A7FA-A7FF AB30-AB5A AB60-AB64 AB66-AB68 "
    "FB00-FB06 1DF00-1DF1E 1DF25-1DF2A"
)
CYRILLIC = "400-482 48A-52F 1C80-1C88 1D2B A640-A66E A67E-A69B 1E051-1E06A"
GREEK = (
    "370-377 37A-37F 384-38A 38C 38E-3A1 3A3-3E1 3F0-3FF 1D26-1D2A 1D66-1D6A 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D "
    "1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FC4 1FC6-1FD3 1FD6-1FDB 1FDD-1FEF 1FF2-1FF4 1FF6-1FFE AB65 "
    "10140-1018D 101A0 1D200-1D241 1D245"
)
JAPANESE = "3040-30FF 3400-4DBF 4E00-9FFF"
#: Look-alikes and what they look like, in matching order.
TWINS_FROM = "АВЕКМНОРСТУХ" "аеорсухі" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ιορυχν"
TWINS_TO = "ABEKMHOPCTYX" "aeopcyxi" "ABEZHIKMNOPTYX" "iopuxv"
SPACES = " 　"
DASHES = "‐‑‒–—―−ーｰ"
FLAG = 0x1F3F4


def ranges(spec: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (part.partition("-") for part in spec.split())]


def points(spec: str) -> list[int]:
    return [p for a, b in ranges(spec) for p in range(a, b + 1)]


def inside(*specs: str) -> str:
    """What goes between the brackets of a class."""
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for spec in specs for a, b in ranges(spec))


def one_of(*specs: str) -> str:
    return f"[{inside(*specs)}]"


def none_of(*specs: str) -> str:
    return f"[^{inside(*specs)}]"


INVISIBLE = f"{ZERO_WIDTH} {BIDI} {TAG} {VARIATION}"
_FULL_WIDTH = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
#: All look-alikes, full-width letters and digits among them.
LOOKALIKES = TWINS_FROM + "".join(map(chr, _FULL_WIDTH))
LOOKALIKE_OF = TWINS_TO + "".join(chr(p - 0xFEE0) for p in _FULL_WIDTH)


def fold_pairs(dashes: bool = False) -> tuple[str, str]:
    """(from, to) for translate(): look-alikes, full-width ASCII and spaces; what has no counterpart is deleted."""
    wide = "".join(chr(p) for p in range(0xFF01, 0xFF5F) if chr(p) not in LOOKALIKES)
    source = LOOKALIKES + wide + SPACES
    target = LOOKALIKE_OF + "".join(chr(ord(c) - 0xFEE0) for c in wide) + "  "
    if dashes:
        source, target = source + DASHES, target + "-" * len(DASHES)
    return source + "".join(map(chr, points(INVISIBLE))), target


#: Kinds of invisible characters that may be stripped, with their characters.
STRIP_KINDS = {
    "zero_width_space": "200B",
    "word_joiner": "2060",
    "bom_mid_text": "FEFF",
    "bidi_control": BIDI,
    "tag_chars": TAG,
}
