"""The objects of a PDF file: tokens, streams through their filters, the page tree and resources."""

from __future__ import annotations

import re
import zlib
from typing import Any

from veilmark.sources import pdf_filters

DEEPEST = 8
_TOKEN = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+|%[^\r\n]*)|(?P<dict><<|>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)"
    rb"|(?P<ref>\d+\s+\d+\s+R(?![A-Za-z]))|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<mark>[\[\]{}])|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)|(?P<string>\()|(?P<other>.)",
    re.DOTALL,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from just after its bracket, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                line = re.match(rb"\r\n|\r|\n", data[at : at + 2])
                out += b"" if line else _ESCAPES.get(data[at : at + 1], data[at : at + 1])
                at += len(line[0]) if line else 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes) -> list[Any]:
    """Numbers, byte strings, names, references, and nested lists and dicts; operators as words."""
    stack: list[list[Any]] = [[]]
    at = 0
    while at < len(data) and (m := _TOKEN.match(data, at)):
        at, kind, raw = m.end(), m.lastgroup, m[0]
        if kind == "string":
            value, at = _string(data, at)
            stack[-1].append(value)
        elif kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            stack[-1].append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "name":
            stack[-1].append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), raw[1:]).decode("latin-1")))
        elif kind == "ref":
            stack[-1].append(Ref(raw.split()[0]))
        elif kind == "number":
            stack[-1].append(float(raw) if b"." in raw else int(raw))
        elif raw in (b"<<", b"["):
            stack.append([])
        elif raw in (b">>", b"]") and len(stack) > 1:
            items = stack.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2])) if raw == b">>" else items)
        elif kind == "word":
            stack[-1].append({b"true": True, b"false": False, b"null": None}.get(raw, Word(raw.decode())))
            if raw == b"ID":  # an inline image's data
                end = re.search(rb"\sEI(?=\s|$)", data[at:])
                at = at + end.end() if end else len(data)
    while len(stack) > 1:
        items = stack.pop()
        stack[-1].append(items)
    return stack[0]


class File:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF")
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[Any, bytes]] = {}
        self.fonts: dict[Any, Any] = {}  # by number, once they have been read
        marks = list(re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data))
        for m, limit in zip(marks, [*(x.start() for x in marks[1:]), len(data)]):
            end = data.find(b"endobj", m.end(), limit)
            head, _, stream = data[m.end() : end if end >= 0 else limit].partition(b"stream")
            value = tokens(head)
            size = value[0].get("Length") if value and isinstance(value[0], dict) else None
            body = re.sub(rb"^\r?\n", b"", stream, count=1)
            self.objects[int(m[1])] = (value[0] if value else None, body[:size] if isinstance(size, int) and not isinstance(size, Ref) else body.rsplit(b"endstream", 1)[0])
        for value, body in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                inner = self.unpacked(value, body)
                first = self.get(value.get("First"), 0)
                pairs = [int(x) for x in inner[:first].split()]
                ends = [*pairs[3::2], len(inner) - first]
                for number, start, end in zip(pairs[::2], pairs[1::2], ends):
                    found = tokens(inner[first + start : first + end])
                    self.objects.setdefault(number, (found[0] if found else None, b""))
        trailers = [t for m in re.finditer(rb"trailer\s*(<<.*?>>)\s*startxref", data, re.DOTALL) for t in tokens(m[1]) if isinstance(t, dict)]
        trailers += [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "XRef"]
        self.trailer = {k: v for t in trailers for k, v in t.items()}

    def get(self, value: Any, other: Any = None) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, b""))[0]
        return other if value is None else value

    def unpacked(self, head: dict, body: bytes) -> bytes:
        """A stream's body through its filters, one after the other; ValueError for what can't be had."""
        filters, parameters = (self.get(head.get(long, head.get(short)), []) for long, short in (("Filter", "F"), ("DecodeParms", "DP")))
        filters = filters if isinstance(filters, list) else [filters]
        parameters = parameters if isinstance(parameters, list) else [parameters]
        for i, name in enumerate(filters):
            own = self.get(parameters[i]) if i < len(parameters) else None
            try:
                body = pdf_filters.unpack(body, str(self.get(name)), {k: self.get(v) for k, v in own.items()} if isinstance(own, dict) else {})
            except zlib.error as e:
                raise ValueError("filter") from e
        return body

    def stream(self, value: Any) -> bytes:
        if isinstance(own := self.get(value), list):
            return b"\n".join(map(self.stream, own))
        head, body = self.objects.get(int(value), (None, b"")) if isinstance(value, Ref) else (None, b"")
        return self.unpacked(head, body) if isinstance(head, dict) else b""

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        found: list[dict] = []

        def walk(value: Any, above: dict, seen: frozenset) -> None:
            own = self.get(value)
            if not isinstance(own, dict) or value in seen:
                return
            own = {k: above[k] for k in ("MediaBox", "CropBox", "Resources") if k in above} | own
            if "Kids" in own:
                for kid in self.get(own["Kids"], []):
                    walk(kid, own, seen | {value} if isinstance(value, Ref) else seen)
            else:
                found.append(own)

        walk(self.root().get("Pages"), {}, frozenset())
        return found

    def root(self) -> dict:
        return self.get(self.trailer.get("Root")) or next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})

    def named(self, resources: Any, kind: str) -> dict:
        """The entries of a kind in resources."""
        own = self.get(resources)
        found = self.get(own.get(kind)) if isinstance(own, dict) else None
        return found if isinstance(found, dict) else {}

    def forms(self, resources: Any, deepest: int | None = DEEPEST) -> list[tuple[str, Any]]:
        """(name, reference) of every form that resources declare, each before what it declares itself, none twice; all if ``deepest`` is None."""
        found: list[tuple[str, Any]] = []
        waiting, seen = [(iter(self.named(resources, "XObject").items()), 0)], set()
        while waiting:
            entries, depth = waiting[-1]
            name, value = next(entries, (None, None))
            if name is None:
                waiting.pop()
                continue
            form = self.get(value)
            key = int(value) if isinstance(value, Ref) else id(form)
            if not isinstance(form, dict) or form.get("Subtype") != "Form" or key in seen:
                continue
            seen.add(key)
            if deepest is None or depth <= deepest:
                found.append((f"/{name}", value))
                waiting.append((iter(self.named(form.get("Resources"), "XObject").items()), depth + 1))
        return found


def said(raw: Any) -> str:
    if not isinstance(raw, bytes):
        return ""
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
