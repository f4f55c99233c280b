"""A subset of PDF, with the standard library: hidden text on pages, metadata and annotations.

Read are classic and compressed objects, streams through every filter for data, page trees with inherited boxes and
resources, forms, optional content in the default configuration, and the content operators for graphics state, colour, paths,
text state, text and marks.  Characters are those that the fonts say.  Text keeps the order in which it is shown; where the
next piece stands decides whether a line, a blank or nothing is between.  Not read, and said so: encrypted files, and streams
whose filters are for pictures (such pages are withheld).

A page is judged by one interpreter over a stack of open streams: its own, and on top of it the forms that are drawn.
What can't be followed for certain (a form drawn again in another state, nesting too deep, layers that can't be told)
withholds the page's visible text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import hypot, sqrt
from typing import Any

from veilmark.functions import chars
from veilmark.sources.pdf_fonts import Font, usual_width
from veilmark.sources.pdf_syntax import DEEPEST, File, Name, Ref, Word, said, tokens
from veilmark.sources.reading import Found, Limits, Segment, register

LEAST, TINY, WHITE, LABEL = 10, 2.0, 0.98, 40
#: In units of the size: a piece this much further along begins a word, this much above or below begins a line.
WORD_GAP, LINE_GAP = 0.2, 0.5
WITHHELD = "Extraction failed"
_INVISIBLE = frozenset(map(chr, chars.points(chars.INVISIBLE)))
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def product(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def scale(m: Matrix) -> float:
    return sqrt(abs(m[0] * m[3] - m[1] * m[2]))


#: How many numbers a colour of each device space has.
DEVICES = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}


@dataclass(frozen=True)
class Colour:
    """A colour in its space; a space that isn't a device's is None, and so are values that can't be told."""

    space: str | None = "DeviceGray"
    values: tuple[float, ...] | None = (0.0,)

    @staticmethod
    def first(space: str | None) -> Colour:
        """What a space begins with: black."""
        return Colour(space, None if space is None else (0.0, 0.0, 0.0, 1.0) if space == "DeviceCMYK" else (0.0,) * DEVICES[space])

    def of(self, operands: list[Any]) -> Colour:
        """Another colour of the same space."""
        plain = all(isinstance(x, (int, float)) and not isinstance(x, (bool, Ref)) for x in operands)
        return Colour(self.space, tuple(map(float, operands)) if self.space and plain and len(operands) == DEVICES[self.space] else None)

    def near_white(self) -> bool | None:
        """None if it can't be told."""
        if self.values is None:
            return None
        if self.space == "DeviceCMYK":
            return all(c <= round(1 - WHITE, 9) for c in self.values)
        return all(c >= WHITE for c in self.values)


class Untold(Exception):
    """What is shown can't be told for certain."""


class Layers:
    """Optional content: what is off in the document's default configuration."""

    def __init__(self, file: File) -> None:
        self.file = file
        properties = file.get(file.root().get("OCProperties"))
        default = file.get(properties.get("D")) if isinstance(properties, dict) else None
        self.default: dict = default if isinstance(default, dict) else {}

    def marked(self, value: Any) -> Any:
        """A reference to optional content, once it is known to be one that can be judged."""
        own = self.file.get(value)
        if not isinstance(own, dict) or own.get("VE") is not None:
            raise Untold("optional content")
        return value

    def off(self, value: Any, depth: int = 0) -> bool:
        own = self.file.get(value)
        if not isinstance(own, dict) or own.get("VE") is not None or depth > DEEPEST + 1:
            raise Untold("optional content")
        if own.get("OCGs") is not None:
            members = self.file.get(own["OCGs"])
            members = [own["OCGs"]] if isinstance(members, dict) else members or []
            states = [self.off(m, depth + 1) for m in members]
            policy = {"AnyOn": all(states), "AllOn": any(states), "AnyOff": not any(states), "AllOff": not all(states)}
            said = str(own.get("P", "AnyOn"))
            if said not in policy:
                raise Untold("optional content")
            return policy[said]
        listed = lambda key: value in (self.file.get(self.default.get(key)) or [])
        return listed("OFF") or (self.default.get("BaseState") == "OFF" and not listed("ON"))

    def label(self, value: Any, name: str | None) -> str:
        """off_layer, with the group's own name, or else the name that the content calls it by."""
        own = self.file.get(value)
        texts = (cleaned(said(own.get("Name"))), cleaned(name or ""))
        found = next((t for t in texts if t), None)
        return f"off_layer '{found}'" if found else "off_layer"


def cleaned(text: str, most: int = LABEL) -> str:
    """Printable characters only, blanks as one, cut with dots."""
    plain = " ".join("".join(" " if c.isspace() else c for c in text if c.isspace() or c.isprintable()).split())
    return plain if len(plain) <= most else plain[:most] + "..."


@dataclass
class State:
    ctm: Matrix = UNIT
    mode: int = 0
    size: float | None = None
    font: Any = None
    leading: float = 0.0
    fill: Colour = Colour()
    stroke: Colour = Colour()
    line: Matrix = UNIT
    pen: float = field(default=0.0, compare=False)  # how far along its line text has come


@dataclass
class Open:
    """A content stream that is being read: what comes next, its resources, and what holds again after it."""

    operations: Iterator[tuple[str, list[Any]]]
    resources: Any
    form: int | None = None
    after: tuple[State, tuple] | None = None
    saved: list[State] = field(default_factory=list)


@dataclass
class Shown:
    """A piece of text, its bytes as Latin-1, why it is hidden, and from where to where it stands on the page at which size."""

    text: str
    raw: str
    label: str | None
    form: int | None
    start: tuple[float, float] = (0.0, 0.0)
    end: tuple[float, float] = (0.0, 0.0)
    size: float = 0.0
    sure: bool = True


def assembled(pieces: list[Shown]) -> str:
    """The pieces' text in order, with line ends and blanks where the next piece stands apart from the one before."""
    out: list[str] = []
    before: Shown | None = None
    for p in pieces:
        if before is not None:
            mark = _between(before, p)
            out.append(mark if mark != " " or not (out[-1][-1:].isspace() or p.text[:1].isspace()) else "")
        out.append(p.text)
        before = p
    return "".join(out)


def _between(a: Shown, b: Shown) -> str:
    size = max(a.size, 0.1)
    along, across = a.end[0] - a.start[0], a.end[1] - a.start[1]
    wide = hypot(along, across)
    along, across = (along / wide, across / wide) if wide else (1.0, 0.0)
    x, y = b.start[0] - a.end[0], b.start[1] - a.end[1]
    ahead, aside = x * along + y * across, abs(y * along - x * across)
    if aside > LINE_GAP * size:
        return "\n"
    back = (b.start[0] - a.start[0]) * along + (b.start[1] - a.start[1]) * across
    if back < -WORD_GAP * size:
        return "\n"  # on the same line, but further to the left: it is another one's
    unsure = 0.0 if a.sure else 0.12 * wide
    return " " if ahead > WORD_GAP * size + unsure else ""


@dataclass
class Drawn:
    """How a form was drawn: its state, marks and, once it is done, what had been painted."""

    state: State
    marks: tuple
    paints: list[tuple[float, float, float, float]] = field(default_factory=list)


def operations(content: bytes) -> Iterator[tuple[str, list[Any]]]:
    operands: list[Any] = []
    for token in tokens(content):
        if isinstance(token, Word):
            yield str(token), operands
            operands = []
        else:
            operands.append(token)


class Canvas:
    """What streams show on a page, in order; hidden pieces carry a label."""

    def __init__(self, file: File, layers: Layers, box: tuple[float, float, float, float] | None, state: State | None = None, marks: tuple = (), paints: list | None = None) -> None:
        self.file, self.layers, self.box = file, layers, box
        self.state, self.marks, self.paints = state or State(), marks, list(paints or [])
        self.shown: list[Shown] = []
        self.drawn: dict[int, Drawn] = {}
        self.again: dict[int, list[Shown]] = {}
        self.unresolved = self.on_painted = 0
        self.path: list[tuple[float, float]] = []
        self.open: list[Open] = []

    def read(self, content: bytes, resources: Any, follow: bool = True) -> None:
        """One stream to its end, with the forms that it draws if ``follow``."""
        self.open = [Open(operations(content), resources)]
        while self.open:
            name, operands = next(self.open[-1].operations, (None, None))
            if name is None:
                self.close(self.open.pop())
            elif name == "Do":
                if follow and operands:
                    self.draw(operands[0])
            elif name in ("BDC", "BMC", "EMC"):
                self.mark(name, operands)
            else:
                self.operate(name, operands)

    def close(self, ended: Open) -> None:
        if ended.after is None:
            return
        self.state, self.marks = ended.after
        self.drawn[ended.form].paints = list(self.paints)

    def draw(self, name: Any) -> None:
        resources = self.open[-1].resources
        value = self.file.named(resources, "XObject").get(name)
        thing = self.file.get(value)
        if not isinstance(thing, dict):
            return
        if thing.get("Subtype") == "Image":
            self.paints.append(_bounds([apply(self.state.ctm, x, y) for x in (0, 1) for y in (0, 1)]))
        if thing.get("Subtype") != "Form":
            return
        key = int(value) if isinstance(value, Ref) else id(thing)
        if key in self.drawn:
            if (self.drawn[key].state, self.drawn[key].marks) != (self.state, self.marks):
                raise Untold("a form in two states")
            if not any(o.form == key for o in self.open):
                self.shown += [replace(p) for p in self.shown if p.form == key and p.label is None]
            return
        if len(self.open) > DEEPEST:
            raise Untold("forms too deep")
        self.drawn[key] = Drawn(replace(self.state), self.marks)
        after = (replace(self.state), self.marks)
        if thing.get("OC") is not None:
            self.marks += ((self.layers.marked(thing["OC"]), None),)
        self.open.append(Open(operations(self.file.stream(value)), thing.get("Resources"), key, after))

    def mark(self, name: str, operands: list[Any]) -> None:
        """Marked content: a stack of its own, which saving and restoring don't touch."""
        if name == "EMC":
            self.marks = self.marks[:-1]
            return
        found: tuple = (None, None)
        if name == "BDC" and len(operands) > 1:
            called = operands[1] if isinstance(operands[1], Name) else None
            value = self.file.named(self.open[-1].resources, "Properties").get(called) if called is not None else operands[1]
            own = self.file.get(value)
            if called is not None and own is None:
                raise Untold("optional content")
            label = f"/{called}" if called is not None else None
            if isinstance(own, dict) and own.get("OC") is not None:
                found = (self.layers.marked(own["OC"]), label)
            elif isinstance(own, dict) and (own.get("OCGs") is not None or own.get("Type") == "OCG"):
                found = (self.layers.marked(value), label)
        self.marks += (found,)

    def operate(self, name: str, o: list[Any]) -> None:
        s = self.state
        if name == "q":
            self.open[-1].saved.append(replace(s))
        elif name == "Q":
            if self.open[-1].saved:
                self.state = replace(self.open[-1].saved.pop(), line=s.line, pen=s.pen)
        elif name == "cm":
            s.ctm = product(_matrix(o), s.ctm)
        elif name == "BT":
            s.line, s.pen = UNIT, 0.0
        elif name in ("Td", "TD", "Tm", "T*"):
            if name == "TD":
                s.leading = -float(o[-1])
            s.line = _matrix(o) if name == "Tm" else product((1, 0, 0, 1, *((0.0, -s.leading) if name == "T*" else map(float, o[-2:]))), s.line)
            s.pen = 0.0
        elif name == "TL":
            s.leading = float(o[-1])
        elif name == "Tf":
            s.size, s.font = float(o[-1]), self.font(o[-2])
        elif name == "Tr":
            s.mode = int(o[-1])
        elif name in _DEVICE_OPERATORS:
            which, space = _DEVICE_OPERATORS[name]
            setattr(s, which, Colour.first(space).of(o))
        elif name in ("cs", "CS"):
            setattr(s, "fill" if name == "cs" else "stroke", Colour.first(self.space(o[-1] if o else None)))
        elif name in ("sc", "scn"):
            s.fill = s.fill.of(o)
        elif name in ("SC", "SCN"):
            s.stroke = s.stroke.of(o)
        elif name in _PATH_POINTS:
            self.build(name, o)
        elif name in _PATH_ENDS:
            if name in _FILLS and self.path and s.fill.near_white() is False:
                self.paints.append(_bounds(self.path))
            self.path = []
        elif name in ("Tj", "'", '"', "TJ"):
            if name in ("'", '"'):
                self.operate("T*", [])
            self.show(o[-1] if name == "TJ" and isinstance(o[-1], list) else o[-1:])

    def space(self, name: Any) -> str | None:
        """The device's colour space that a name means, itself or in the resources; None for any other."""
        value = self.file.get(self.file.named(self.open[-1].resources, "ColorSpace").get(name)) if isinstance(name, Name) and name not in DEVICES else name
        if isinstance(value, list) and len(value) == 1:
            value = self.file.get(value[0])
        return str(value) if isinstance(value, Name) and value in DEVICES else None

    def font(self, name: Any) -> Any:
        """The key of the font that the resources name so."""
        value = self.file.named(self.open[-1].resources, "Font").get(name)
        key = int(value) if isinstance(value, Ref) else id(value) if value is not None else None
        if key is not None and key not in self.file.fonts:
            self.file.fonts[key] = Font(self.file, value)
        return key

    def build(self, name: str, o: list[Any]) -> None:
        """The points of a path, control points of curves included, where they lie on the page."""
        n = [float(x) for x in o if isinstance(x, (int, float)) and not isinstance(x, (bool, Ref))][: _PATH_POINTS[name]]
        if len(n) < _PATH_POINTS[name]:
            return
        if name == "re":
            x, y, w, h = n
            n = [x, y, x + w, y, x, y + h, x + w, y + h]
        self.path += [apply(self.state.ctm, x, y) for x, y in zip(n[::2], n[1::2])]

    def show(self, parts: list[Any]) -> None:
        """Strings shown one after the other, and in between how much the next one is moved back."""
        s, form = self.state, self.open[-1].form
        font, told = self.file.fonts.get(s.font), True
        texts, raws, begin, wide, most = [], [], s.pen, 0.0, 0.0
        for part in parts:
            if isinstance(part, bytes) and part:
                raw = said(part)
                text, width, bound = font.read(part) if font is not None else (raw, usual_width(raw), float(len(raw)))
                texts.append(text)
                raws.append(raw)
                wide, most, told = wide + width, most + bound, told and abs(bound - width) < 1e-9
            elif isinstance(part, (int, float)) and not isinstance(part, (bool, Ref)):
                if -part / 1000 > WORD_GAP and texts and not texts[-1][-1:].isspace():
                    texts.append(" ")
                wide -= part / 1000
        if not raws:
            return
        s.pen = begin + wide * (s.size or 0.0)
        whole = product(s.line, s.ctm)
        size = (s.size or 0.0) * scale(s.line) * scale(s.ctm)
        self.shown.append(Shown("".join(texts), "".join(raws), self.hidden(most), form, apply(whole, begin, 0.0), apply(whole, s.pen, 0.0), size, told))

    def hidden(self, wide: float) -> str | None:
        """Why a piece that is so wide at most can't be seen: the first of the fixed order that holds."""
        s, whole = self.state, product(self.state.line, self.state.ctm)
        if s.mode in (3, 7):
            return f"invisible text, Tr {s.mode}"
        size = (s.size or 0.0) * scale(s.line) * scale(s.ctm)
        if s.size is not None and size < TINY:
            return "tiny_font"
        x, y = whole[4], whole[5]
        if self.box is not None and not (self.box[0] <= x <= self.box[2] and self.box[1] <= y <= self.box[3]):
            return "off_page"
        for value, name in self.marks:
            if value is not None and self.layers.off(value):
                return self.layers.label(value, name)
        shades = [c.near_white() for c in ([s.fill] if s.mode in (0, 4) else [s.stroke] if s.mode in (1, 5) else [s.fill, s.stroke])]
        if None in shades:
            self.unresolved += 1
        elif all(shades):
            height = s.size or 0.0
            width = height * wide
            low_x, low_y, high_x, high_y = _bounds([apply(whole, *p) for p in ((0, 0), (width, 0), (0, height), (width, height))])
            if not any(b[0] <= low_x and b[1] <= low_y and high_x <= b[2] and high_y <= b[3] for b in self.paints):
                return "white_text"
            self.on_painted += 1
        return None


#: Operators of colours, with what they set; of paths, with how many numbers they take; and of filled paths.
_DEVICE_OPERATORS = {"g": ("fill", "DeviceGray"), "rg": ("fill", "DeviceRGB"), "k": ("fill", "DeviceCMYK"), "G": ("stroke", "DeviceGray"), "RG": ("stroke", "DeviceRGB"), "K": ("stroke", "DeviceCMYK")}
_PATH_POINTS = {"m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4}
_PATH_ENDS = frozenset(("f", "F", "f*", "B", "B*", "b", "b*", "n", "S", "s"))
_FILLS = frozenset(("f", "F", "f*", "B", "b"))


def _matrix(operands: list[Any]) -> Matrix:
    numbers = tuple(map(float, operands))
    if len(numbers) != 6:
        raise ValueError("matrix")
    return numbers


def _bounds(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def by_label(pieces: list[Shown]) -> list[tuple[str, str]]:
    """(label, text) of hidden pieces, in the order of first appearance."""
    found: dict[str, list[str]] = {}
    for p in pieces:
        if p.label is not None:
            found.setdefault(p.label, []).append(p.text)
    return [(label, "".join(texts)) for label, texts in found.items()]


def _box(file: File, page: dict) -> tuple[float, float, float, float]:
    box = [float(file.get(x)) for x in file.get(page.get("CropBox")) or file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    return min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])


def _page(file: File, layers: Layers, page: dict, where: str, counts: dict[str, int]) -> list[Segment]:
    """A page's text, what it hides, and what the forms that it declares hide, drawn or not."""
    own: Canvas | None = None
    try:
        own = Canvas(file, layers, _box(file, page))
        own.read(file.stream(page.get("Contents")), page.get("Resources"))
    except Exception:  # noqa: BLE001  a page that can't be followed is withheld, not guessed at
        found = [Segment("", True, "body", f"{where} ({WITHHELD})")]
        return found + [Segment(text, False, "css_hidden", f"{where} ({label})") for label, text in by_label([p for p in own.shown if p.form is None] if own else [])]
    visible = assembled([p for p in own.shown if p.label is None])
    found = [Segment(visible, True, "body", where)] if visible.strip() else []
    raw = "".join(p.raw for p in own.shown if p.label is None and p.form is None)
    if not _INVISIBLE.isdisjoint(raw) and _INVISIBLE.isdisjoint(visible):
        found.append(Segment(raw, True, "body", f"{where} (raw stream)"))
    found += [Segment(text, False, "css_hidden", f"{where} ({label})") for label, text in by_label([p for p in own.shown if p.form is None])]
    unresolved, on_painted = own.unresolved, own.on_painted
    for name, value in file.forms(page.get("Resources")):
        form = file.get(value)
        drawn = own.drawn.get(int(value) if isinstance(value, Ref) else id(form))
        try:
            marks = drawn.marks if drawn else ()
            if form.get("OC") is not None:
                marks += ((layers.marked(form["OC"]), None),)
            alone = Canvas(file, layers, own.box if drawn else None, replace(drawn.state) if drawn else None, marks, drawn.paints if drawn else None)
            alone.read(file.stream(value), form.get("Resources"), follow=False)
        except Exception:  # noqa: BLE001  a form that can't be followed adds nothing
            continue
        plain = "".join(p.raw for p in alone.shown if p.label is None)
        unresolved, on_painted = unresolved + alone.unresolved, on_painted + alone.on_painted
        found += [Segment(text, False, "css_hidden", f"{where} (form '{name}', {label})") for label, text in by_label(alone.shown)]
        if not _INVISIBLE.isdisjoint(plain) and _INVISIBLE.isdisjoint(visible):
            found.append(Segment(plain, True, "body", f"{where} (form '{name}', raw stream)"))
    for key, n in (("color_unresolved", unresolved), ("white_on_painted", on_painted)):
        counts[key] = counts.get(key, 0) + n
    return found


def pdf(data: bytes, limits: Limits) -> list[Segment]:
    file = File(data)
    layers, found = Layers(file), Found()
    info = file.get(file.trailer.get("Info"), {})
    for key in INFO:
        if len((text := said(file.get(info.get(key)))).strip()) >= LEAST:
            found.append(Segment(text.strip(), False, "metadata", f"PDF metadata / {key}"))
    for number, page in enumerate(file.pages(), 1):
        found += _page(file, layers, page, f"page {number}", found.counts)
        for k, note in enumerate(file.get(page.get("Annots"), []), 1):
            text = said(file.get(file.get(note, {}).get("Contents"))).strip()
            if len(text) >= LEAST:
                found.append(Segment(text, False, "comment", f"page {number} annotation #{k}"))
    found.counts = {k: n for k, n in found.counts.items() if n}
    return found


def pictures(data: bytes, least: int = 50) -> list[tuple[int, str, int, int, str]]:
    """(page, name, width, height, sha256 of the samples) of a file's pictures, in order, however many and deep in forms.

    Only those of ``least`` pixels both ways; equal ones once, where they come first.  Each is decoded once, one at a time,
    and just its digest kept.  Pictures of other filters than Flate are known by their packed bytes.
    """
    file, found, seen, decoded = File(data), [], set(), set()
    for number, page in enumerate(file.pages(), 1):
        levels = [page.get("Resources"), *(file.get(value).get("Resources") for _, value in file.forms(page.get("Resources"), deepest=None))]
        for name, value in (item for level in levels for item in file.named(level, "XObject").items()):
            head = file.get(value)
            if not isinstance(head, dict) or head.get("Subtype") != "Image" or not isinstance(value, Ref) or int(value) in decoded:
                continue
            width, height = file.get(head.get("Width"), 0), file.get(head.get("Height"), 0)
            if not all(isinstance(n, int) and n >= least for n in (width, height)):
                continue
            decoded.add(int(value))
            try:
                samples = file.stream(value)
            except (ValueError, zlib.error):
                samples = file.objects[int(value)][1]
            digest = hashlib.sha256(samples).hexdigest()
            if digest not in seen:
                seen.add(digest)
                found.append((number, f"/{name}", width, height, digest))
    return found


#: What a finding is about.
PROPERTIES = {"pdf_font_size_tiny": "Tf font size", "pdf_text_out_of_bounds": "Tm position"}


def compact(value: float) -> str:
    """A number without a fraction that is none."""
    return str(int(value)) if abs(value) < 1e16 and value == int(value) else repr(value)


def stated(rule: str, measured: list[float]) -> tuple[str, str]:
    """(property, value) of a finding of ``audit``."""
    return PROPERTIES[rule], " ".join(map(compact, measured))


def _numbers(operands: list[Any]) -> list[float]:
    """Operands that are numbers; none that are too large for one."""
    out = []
    for x in operands:
        if isinstance(x, (int, float)) and not isinstance(x, (bool, Ref)) and abs(x) < 1e300:
            out.append(float(x))
    return out


def _placed(content: bytes, box: list[float], size_max: float, counts: dict[str, int]) -> Iterator[tuple[str, list[float]]]:
    for name, operands in operations(content):
        counts["operators_seen"] += 1
        numbers = _numbers(operands)
        if name == "Tf" and len(operands) >= 2 and numbers and 0 <= numbers[-1] <= size_max:
            yield "pdf_font_size_tiny", numbers[-1:]
        elif name == "Tm" and len(numbers) == 6 and not (min(box[0], box[2]) <= numbers[4] <= max(box[0], box[2]) and min(box[1], box[3]) <= numbers[5] <= max(box[1], box[3])):
            yield "pdf_text_out_of_bounds", numbers[4:]


def audit(data: bytes, size_max: float = 0.5) -> tuple[list[tuple[str, str, str, list[float]]], dict[str, int]]:
    """(origin, location, rule, measured) of what pages and the forms that they declare say, in order; and what was looked at.

    Fonts too small to see, and text placed outside the page.  A declaration is the fact: whether text follows does not
    matter, and the page's own matrix is not applied.
    """
    file, found = File(data), []
    counts = dict.fromkeys(("pages", "page_streams", "form_xobjects", "streams_unreadable", "operators_seen"), 0)
    for number, page in enumerate(file.pages(), 1):
        counts["pages"] += 1
        box = [float(file.get(x)) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        streams = [("page_stream", f"page {number}", page["Contents"])] if page.get("Contents") is not None else []
        streams += [("form_stream", f"page {number} (form '{name}')", value) for name, value in file.forms(page.get("Resources"))]
        for origin, where, value in streams:
            counts["page_streams" if origin == "page_stream" else "form_xobjects"] += 1
            try:
                content = file.stream(value)
            except (ValueError, zlib.error):
                counts["streams_unreadable"] += 1
                continue
            found += [(origin, where, rule, measured) for rule, measured in _placed(content, box, size_max, counts)]
    return found, counts


def geometry(data: bytes, size_max: float = 0.5) -> list[tuple[str, str, list[float]]]:
    """(rule, where, measured) of ``audit``."""
    return [(rule, where, measured) for _, where, rule, measured in audit(data, size_max)[0]]


register(".pdf", pdf)
