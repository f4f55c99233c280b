"""Character tables that are kept as pinned documents: read whole, checked against a digest, refused on any doubt.

A table lists invisible characters by kind, look-alikes with their ASCII twins, the full-width range, and spaces and
dashes that fold.  Nothing falls back to other values: a table that isn't the pinned one, or isn't well formed, is an
error.  Each call reads anew, so that no caller sees what another has changed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

#: The digest of the table of version 1, and its kinds of invisible characters.
PIN = "c5ae4757bc9d07a2dcd1507d662460c3412c932d73318e54912569608242e605"
KINDS = ("bidi_control", "tag", "variation_selector", "zero_width")
_POINT = re.compile(r"[0-9A-Fa-f]{4,6}\Z")


class TableError(Exception):
    """The table is missing, not the pinned one, or malformed."""


@dataclass
class Table:
    invisible: dict[str, list[tuple[int, int]]]
    twins: dict[int, str]
    wide: tuple[int, int, int]  # first, last, and what the first stands for
    spaces: list[int]
    dashes: list[int]

    def fold_pairs(self, dashes: bool = False) -> tuple[str, str]:
        """(from, to) for translate(); what has no counterpart is deleted."""
        low, high, base = self.wide
        pairs = {chr(p): chr(base + p - low) for p in range(low, high + 1)} | {chr(p): t for p, t in self.twins.items()}
        pairs |= {chr(p): " " for p in self.spaces} | ({chr(p): "-" for p in self.dashes} if dashes else {})
        gone = "".join(chr(p) for ranges in self.invisible.values() for a, b in ranges for p in range(a, b + 1))
        return "".join(pairs) + gone, "".join(pairs.values())


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise TableError(f"character table: {what}")


def _point(value: Any) -> int:
    _need(isinstance(value, str) and _POINT.match(value) is not None, f"{value!r} is no code point")
    return int(value, 16)


def _span(value: Any) -> tuple[int, int]:
    """A code point, or a list of the first and last one."""
    ends = value if isinstance(value, list) else [value, value]
    _need(len(ends) == 2, f"{value!r} is no range")
    low, high = map(_point, ends)
    _need(low <= high, f"{value!r} runs backwards")
    return low, high


def _points(value: Any, name: str) -> Iterator[int]:
    _need(isinstance(value, list), f"{name} must be a list")
    return map(_point, value)


def parse(value: Any) -> Table:
    """The table of a parsed document."""
    _need(isinstance(value, dict), "not an object")
    _need(isinstance(value.get("schema"), str) and value["schema"].endswith("-chartable/1"), "unknown schema")
    _need(type(value.get("version")) is int and value["version"] == 1, "unknown version")
    _need(isinstance(value.get("description"), str), "description must be a text")
    invisible, twins, wide = (value.get(k) for k in ("invisible", "twins", "fullwidth_ascii"))
    _need(isinstance(invisible, dict) and sorted(invisible) == list(KINDS), f"invisible must hold {', '.join(KINDS)}")
    _need(all(isinstance(v, list) and v for v in invisible.values()), "a kind of invisible characters is empty")
    _need(isinstance(twins, dict) and bool(twins), "twins must be an object that isn't empty")
    _need(all(isinstance(t, str) and len(t) == 1 and t <= "~" for t in twins.values()), "a twin must be one ASCII character")
    _need(isinstance(wide, dict) and {"base", "from", "to"} <= set(wide), "fullwidth_ascii must have base, from and to")
    low, high = _span([wide["from"], wide["to"]])
    base = _point(wide["base"])
    _need(base + high - low <= 0x7E, "fullwidth_ascii leaves ASCII")
    dashes = list(_points(value.get("dashes"), "dashes"))
    _need(len(set(dashes)) == len(dashes), "a dash occurs twice")
    return Table({k: [_span(x) for x in v] for k, v in invisible.items()}, {_point(p): t for p, t in twins.items()}, (low, high, base), list(_points(value.get("spaces"), "spaces")), dashes)


def load(raw: bytes, pin: str = PIN) -> Table:
    """The table of exactly the pinned bytes."""
    found = hashlib.sha256(raw).hexdigest()
    _need(found == pin, f"sha256 {found} is not the pinned {pin}")
    try:
        value = json.loads(raw.decode("utf-8"))
    except ValueError as e:
        raise TableError(f"character table: not JSON in UTF-8 ({e})") from None
    return parse(value)


def read(path: str, pin: str = PIN) -> Table:
    try:
        with open(path, "rb") as file:
            raw = file.read()
    except OSError as e:
        raise TableError(f"character table: missing ({e.strerror})") from None
    return load(raw, pin)
