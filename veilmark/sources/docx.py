"""Word documents as segments, with the reasons for which runs can't be seen.

A document is read in two steps: bounded parts become element trees; a walk over a tree turns every paragraph into a
list of runs, each with its effective properties, which a small set of rules judges.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections import ChainMap
from collections.abc import Iterator
from dataclasses import dataclass, replace
from xml.etree import ElementTree

from veilmark.sources.reading import Limits, Refused, Segment, register

# Namespaces, Word's highlight colours, theme colour names, limits.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
CP = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
HIGHLIGHTS = {
    "black": "000000", "blue": "0000FF", "cyan": "00FFFF", "darkblue": "000080", "darkcyan": "008080", "darkgray": "808080", "darkgreen": "008000", "darkmagenta": "800080",
    "darkred": "800000", "darkyellow": "808000", "green": "00FF00", "lightgray": "C0C0C0", "magenta": "FF00FF", "red": "FF0000", "white": "FFFFFF", "yellow": "FFFF00",
}
THEME_NAMES = {"background1": "bg1", "light1": "bg1", "text1": "t1", "dark1": "t1", "background2": "bg2", "light2": "bg2", "text2": "t2", "dark2": "t2"}
THEME_DEFAULTS = {"bg1": "light1", "t1": "dark1", "bg2": "light2", "t2": "dark2"}
THEME_SLOTS = {"dark1": "dk1", "light1": "lt1", "dark2": "dk2", "light2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}
REASONS = ("vanish", "low_contrast", "tiny_font", "tracked_deletion")
LEAST_STEP, MOST_HALF_POINTS, DEEPEST_CHAIN, LEAST = 20, 2, 100, 10
Element = ElementTree.Element


def local(element: Element) -> str:
    return element.tag.rpartition("}")[2]


def value(element: Element | None, name: str = "val") -> str | None:
    return None if element is None else element.get(W + name)


def colour(text: str | None) -> str | None:
    text = (text or "").strip()
    return text.upper() if re.fullmatch(r"[0-9A-Fa-f]{6}", text) else None


def switched(element: Element | None) -> bool | None:
    """An on/off property: on when it has no value, unknown when that is no switch."""
    said = value(element)
    if element is None or said is None:
        return None if element is None else True
    return {"1": True, "true": True, "on": True, "0": False, "false": False, "off": False}.get(said.strip().lower())


def luma(hex6: str) -> int:
    red, green, blue = bytes.fromhex(hex6)
    return 2126 * red + 7152 * green + 722 * blue


class Package:
    """The parts of a file, read within the limits."""

    def __init__(self, data: bytes, limits: Limits) -> None:
        self.zip, self.limits, self.read = zipfile.ZipFile(io.BytesIO(data)), limits, 0
        names = [i.filename for i in self.zip.infolist()]
        if len(names) > limits.entries:
            raise Refused("too_many_entries")
        if len({n.lower() for n in names}) < len(names):
            raise Refused("duplicate_part")
        self.names = sorted(names)

    def part(self, name: str, root: str | None = None) -> Element | None:
        """The tree of a part, None if there is none; ``root`` is the Word element that it must be."""
        if name not in self.names:
            return None
        info = self.zip.getinfo(name)
        if info.flag_bits & 1:
            raise Refused("encrypted")
        if info.file_size > self.limits.part_bytes:
            raise Refused("part_too_large")
        with self.zip.open(info) as stream:
            data = stream.read(self.limits.part_bytes + 1)
        if len(data) > self.limits.part_bytes:
            raise Refused("part_too_large")
        self.read += len(data)
        if self.read > self.limits.total_bytes:
            raise Refused("total_too_large")
        said = re.match(rb"<\?xml\s[^>]*?encoding\s*=\s*[\"']([^\"']+)", data.removeprefix(b"\xef\xbb\xbf"))
        if data[:2] in (b"\xff\xfe", b"\xfe\xff") or said and said[1].strip().lower() not in (b"utf-8", b"utf8"):
            raise Refused("unsupported_encoding")
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise Refused("doctype_not_allowed")
        if data.count(b"<") > self.limits.elements:
            raise Refused("too_many_elements")
        try:
            tree = ElementTree.fromstring(data)
        except (ElementTree.ParseError, ValueError):
            raise Refused("malformed_xml") from None
        if root is not None and tree.tag != W + root:
            raise Refused("unsupported_namespace")
        return tree


class Formats:
    """Effective run properties: document defaults, then styles from the most basic on, then the run's own."""

    def __init__(self, styles: Element | None, theme: Element | None, settings: Element | None) -> None:
        self.own: dict[str, dict[str, Element]] = {}
        self.base: dict[str, str | None] = {}
        self.defaults: dict[str, Element] = {}
        if styles is not None:
            self.defaults = self.of(styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"))
            for style in styles.iter(W + "style"):
                if name := value(style, "styleId"):
                    self.own[name], self.base[name] = self.of(style.find(W + "rPr")), value(style.find(W + "basedOn"))
        self.slots: dict[str, str] = {}
        for slot in [] if theme is None else theme.findall(f"{A}themeElements/{A}clrScheme/*"):
            found = (colour(c.get("val") if local(c) == "srgbClr" else c.get("lastClr") if local(c) == "sysClr" else None) for c in slot)
            if first := next(filter(None, found), None):
                self.slots[local(slot)] = first
        mapping = None if settings is None else settings.find(W + "clrSchemeMapping")
        self.mapping = {n: value(mapping, n) or d for n, d in (THEME_DEFAULTS | {n: n for n in ("hyperlink", "followedHyperlink", *(f"accent{i}" for i in range(1, 7)))}).items()}
        shape = None if settings is None else settings.find(W + "displayBackgroundShape")
        self.shows_background = shape is not None and switched(shape) is not False

    @staticmethod
    def of(properties: Element | None) -> dict[str, Element]:
        return {} if properties is None else {local(p): p for p in properties}

    def chain(self, style: str | None) -> list[dict[str, Element]]:
        """The style's properties and those it is based on, nearest first."""
        found, seen = [], set()
        while style in self.own:
            if style in seen or len(seen) >= DEEPEST_CHAIN:
                raise Refused("malformed_xml")
            seen.add(style)
            found.append(self.own[style])
            style = self.base[style]
        return found

    def effective(self, run: Element | None, paragraph_style: str | None) -> ChainMap:
        own = self.of(run)
        return ChainMap(own, *self.chain(value(own.get("rStyle"))), *self.chain(paragraph_style), self.defaults)

    def text_colour(self, element: Element | None) -> str | None:
        if element is None:
            return None
        theme = value(element, "themeColor")
        if theme and theme != "none" and not value(element, "themeTint") and not value(element, "themeShade"):
            index = self.mapping.get(THEME_NAMES.get(theme, theme))
            if found := self.slots.get(THEME_SLOTS.get(index, index)):
                return found
        return colour(value(element))

    def page(self, root: Element) -> str | None:
        return colour(value(root.find(W + "background"), "color")) if self.shows_background else None


def shading(element: Element | None) -> tuple[str | None, bool]:
    """(colour, whether nothing can be said): a pattern of two colours shows neither."""
    kind, fill, over = value(element), colour(value(element, "fill")), colour(value(element, "color"))
    if element is None or kind == "nil":
        return None, False
    if kind in (None, "clear"):
        return fill, False
    if kind == "solid":
        return over, False
    return (fill, False) if fill and fill == over else (None, True)


@dataclass
class Place:
    """What surrounds a run."""

    paragraph: int | None = None
    style: str | None = None
    paragraph_shade: Element | None = None
    cell_shade: Element | None = None
    deleted: bool = False


class Story:
    """One part's paragraphs, in document order; text counts for every paragraph that it is nested in.

    ``visible`` has an entry for every paragraph element.  ``runs`` has one for every paragraph outside runs (a box
    inside a run is part of that run), under the number it has among those: concealed runs as (reasons, detail, text),
    and None where something else stands between.
    """

    def __init__(self, root: Element, formats: Formats) -> None:
        self.formats, self.page = formats, formats.page(root)
        self.visible: list[list[str]] = []
        self.runs: list[list[tuple[tuple[str, ...], str, str] | None]] = []
        self.walk(root, Place(), ())

    def walk(self, element: Element, place: Place, within: tuple[int, ...]) -> None:
        name = local(element) if element.tag.startswith(W) else ""
        if name == "r":
            self.run(element, place, within)
            return
        if name == "p":
            self.gap(place)
            properties = element.find(W + "pPr")
            style = None if properties is None else value(properties.find(W + "pStyle"))
            shade = None if properties is None else properties.find(W + "shd")
            place = Place(len(self.runs), style, shade, place.cell_shade, place.deleted)
            within = (*within, len(self.visible))
            self.runs.append([])
            self.visible.append([])
        elif name == "tc":
            place = replace(place, cell_shade=element.find(f"{W}tcPr/{W}shd"))
        elif name in ("del", "moveFrom"):
            place = replace(place, deleted=True)
        elif name in ("tbl", "t"):
            self.gap(place)
            if name == "t":
                self.say(element, within)
        for child in element:
            self.walk(child, place, within)

    def run(self, element: Element, place: Place, within: tuple[int, ...]) -> None:
        hidden = self.judge(element, place) if place.paragraph is not None else None
        hidden = hidden if hidden and hidden[2].strip() else None
        if place.paragraph is not None:
            self.runs[place.paragraph].append(hidden)
        for inner in (element, *element.iter(W + "p")):
            if inner is not element:
                within = (len(self.visible),)
                self.visible.append([])
            for piece in [] if hidden else inner.iter(W + "t"):
                self.say(piece, within)

    def gap(self, place: Place) -> None:
        if place.paragraph is not None:
            self.runs[place.paragraph].append(None)

    def say(self, piece: Element, within: tuple[int, ...]) -> None:
        for number in within:
            self.visible[number].append(piece.text or "")

    def judge(self, run: Element, place: Place) -> tuple[tuple[str, ...], str, str] | None:
        own = self.formats.effective(run.find(W + "rPr"), place.style)
        sizes = [value(own.get(k)) or "" for k in ("sz", "szCs")]
        front, (back, source) = self.formats.text_colour(own.get("color")), self.background(own, place)
        found = {
            "vanish": switched(own.get("vanish")) is True,
            "low_contrast": bool(front and back) and abs(luma(front) - luma(back)) // 10_000 < LEAST_STEP,
            "tiny_font": any(re.fullmatch(r"\s*[+-]?\d+\s*", s) and int(s) <= MOST_HALF_POINTS for s in sizes),
            "tracked_deletion": place.deleted or run.find(W + "delText") is not None,
        }
        reasons = tuple(r for r in REASONS if found[r])
        if not reasons:
            return None
        detail = ",".join(reasons) + (f" (fg={front},bg={back},src={source})" if found["low_contrast"] else "")
        return reasons, detail, "".join(c.text or "" for c in run if c.tag in (W + "t", W + "delText"))

    def background(self, own: ChainMap, place: Place) -> tuple[str | None, str | None]:
        marked = HIGHLIGHTS.get((value(own.get("highlight")) or "").strip().lower())
        if marked:
            return marked, "highlight"
        for element, source in ((own.get("shd"), "run_shading"), (place.paragraph_shade, "paragraph_shading"), (place.cell_shade, "cell_shading")):
            found, unclear = shading(element)
            if unclear:
                return None, None
            if found:
                return found, source
        return (self.page, "page_background") if self.page else ("FFFFFF", "default")

    def segments(self, kind: str, label: str) -> Iterator[Segment]:
        for number, (visible, runs) in enumerate(itertools.zip_longest(self.visible, self.runs, fillvalue=()), 1):
            where, text = f"{label} {number}", "".join(visible)
            if text.strip():
                yield Segment(text, True, kind, where)
            for reasons, group in itertools.groupby(runs, key=lambda r: r and r[0]):
                if reasons:
                    concealed = list(group)
                    yield Segment("".join(r[2] for r in concealed), False, "docx_hidden", where, concealed[0][1])


def _long(elements: Iterator[tuple[str, str]], kind: str) -> Iterator[Segment]:
    for text, where in elements:
        if len(text.strip()) >= LEAST:
            yield Segment(text.strip(), False, kind, where)


def _numbered(tree: Element | None, tag: str, typed: bool = True) -> Iterator[tuple[str, str]]:
    for number, item in enumerate([] if tree is None else tree.iter(W + tag), 1):
        if typed or not value(item, "type"):
            yield "".join(t.text or "" for t in item.iter(W + "t")), f"{tag} #{number}"


def docx(data: bytes, limits: Limits) -> list[Segment]:
    package = Package(data, limits)
    if "word/document.xml" not in package.names:
        raise Refused("main_part_missing")
    body = package.part("word/document.xml", "document")
    formats = Formats(package.part("word/styles.xml", "styles"), package.part("word/theme/theme1.xml"), package.part("word/settings.xml", "settings"))
    found = [*Story(body, formats).segments("body", "paragraph")]
    for name in package.names:
        if edge := re.fullmatch(r"word/((header|footer).*)\.xml", name):
            root = package.part(name, "hdr" if edge[2] == "header" else "ftr")
            found += Story(root, formats).segments("header_footer", edge[1])
    for tag in ("footnote", "endnote"):
        found += _long(_numbered(package.part(f"word/{tag}s.xml", f"{tag}s"), tag, typed=False), "footnote")
    found += _long(_numbered(package.part("word/comments.xml", "comments"), "comment"), "comment")
    core = package.part("docProps/core.xml")
    for tag, label in ((DC + "subject", "dc:subject"), (DC + "description", "dc:description"), (CP + "keywords", "cp:keywords")):
        found += _long(((e.text or "", f"core.xml / {label}") for e in ([] if core is None else core.iter(tag))), "metadata")
    return found


register(".docx", docx)
