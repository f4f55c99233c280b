"""HTML pages as segments: visible and hidden text, comments, and attributes that are read but not seen.

A page is first a flat table of events (markup, text and comments, each with its line).  A fold over the markup gives
each event its scope: how the elements open at that place conceal it.  Segments are then runs of text between two
other events, so nothing is buffered while parsing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby

from veilmark.sources.reading import Limits, Segment, decode, register

#: Styles that hide what they apply to, elements without content, attributes that hold text.
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|font-size\s*:\s*0(?:px|pt|em|rem)?\s*(?:;|$)|(?:left|top|right|bottom)\s*:\s*-\d{4,}", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPOKEN = ("alt", "title", "aria-label")
CODE = frozenset({"style", "script"})
LEAST = 10


@dataclass(frozen=True)
class Event:
    """One thing of a page: kind is open, close, text, comment or end."""

    kind: str
    value: str
    line: int
    attributes: dict[str, str] = field(default_factory=dict)

    def conceals(self, hiding: Callable[[str], bool] = lambda style: HIDING.search(style) is not None) -> bool:
        """Whether an opening tag hides its own content; ``hiding`` judges its style."""
        a = self.attributes
        return "hidden" in a or a.get("aria-hidden") == "true" or hiding(a.get("style", ""))


@dataclass(frozen=True)
class Scope:
    """An open element, the one around it, and whether its content is concealed."""

    tag: str = ""
    concealed: bool = False
    around: Scope | None = None

    def within(self, event: Event, conceals: Callable[[Event], bool]) -> Scope:
        return self if event.value in VOID else Scope(event.value, self.concealed or conceals(event), self)

    def after(self, tag: str) -> Scope:
        """What is open once the nearest element of that name has ended; an end without a beginning changes nothing."""
        found: Scope | None = self
        while found is not None and found.around is not None:
            if found.tag == tag:
                return found.around
            found = found.around
        return self


class _Recorder(HTMLParser):
    """The parser's calls as a list of events."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.feed(page)
        self.close()
        self.record("end", "")

    def record(self, kind: str, value: str, attributes: dict[str, str] | None = None) -> None:
        self.events.append(Event(kind, value, self.getpos()[0], attributes or {}))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.record("open", tag, {name.lower(): value or "" for name, value in attrs})

    def handle_endtag(self, tag: str) -> None:
        self.record("close", tag)

    def handle_data(self, data: str) -> None:
        self.record("text", data)

    def handle_comment(self, data: str) -> None:
        self.record("comment", data)


def events(page: str) -> list[Event]:
    """Everything of a page in order; the last event is its end."""
    return _Recorder(page.removeprefix("﻿")).events


def scoped(page: list[Event], conceals: Callable[[Event], bool] = Event.conceals, outside: frozenset[str] = frozenset()) -> Iterator[tuple[Event, Scope, bool]]:
    """Each event with the scope that it stands in, and whether that is code; tags ``outside`` open no scope."""
    scope, code = Scope(), False
    for event in page:
        yield event, scope, code
        if event.kind == "open":
            scope, code = scope if event.value in outside else scope.within(event, conceals), code or event.value in CODE
        elif event.kind == "close":
            scope, code = scope if event.value in outside else scope.after(event.value), code and event.value not in CODE


def spoken(event: Event) -> Iterator[Segment]:
    """An opening tag's attributes that hold enough text."""
    for name in SPOKEN:
        value = event.attributes.get(name, "")
        if len(value.strip()) >= LEAST:
            yield Segment(value, False, "hidden_attr", f"line {event.line}, <{event.value}> @{name}")


def segments(page: list[Event], conceals: Callable[[Event], bool] = Event.conceals, outside: frozenset[str] = frozenset()) -> Iterator[Segment]:
    """A text's location is the line of the event that ends it."""
    pending = ("", False)
    for is_text, run in groupby(scoped(page, conceals, outside), key=lambda s: s[0].kind == "text"):
        if is_text:
            parts = list(run)
            pending = ("".join(e.value for e, _, code in parts if not code), parts[-1][1].concealed)
            continue
        for event, _, _ in run:
            text, concealed = pending
            if text.strip():
                yield Segment(text, not concealed, "css_hidden" if concealed else "body", f"line {event.line}")
            pending = ("", False)
            if event.kind == "open" and event.value not in outside:
                yield from spoken(event)
            elif event.kind == "comment" and len(event.value.strip()) >= LEAST:
                yield Segment(event.value.strip(), False, "comment", f"line {event.line}")


def styles(page: list[Event]) -> list[dict]:
    """Inline styles: tag, id, line, style."""
    return [{"tag": e.value, "id": e.attributes.get("id", ""), "line": e.line, "style": e.attributes["style"]} for e in page if "style" in e.attributes]


def html(data: bytes, limits: Limits) -> list[Segment]:
    return list(segments(events(decode(data)[0])))


register([".html", ".htm"], html)
