"""All formats that this library reads, in the order in which their extractors are put in place.

A later one takes an extension over from an earlier one.  What can't be offered is listed with its reason, not passed
over in silence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from veilmark.sources import css, docx, html, pdf, pictures, png, reading


@dataclass(frozen=True)
class Format:
    name: str
    install: Callable[[], None] | None
    missing: str = ""


FORMATS = (
    Format("plain text", lambda: reading.register([".txt", ".md"], reading.plain)),
    Format("HTML", lambda: reading.register([".html", ".htm"], html.html)),
    Format("DOCX", lambda: reading.register(".docx", docx.docx)),
    Format("PDF", lambda: reading.register(".pdf", pdf.pdf)),
    Format("pictures of PDF", lambda: reading.register(".pdf", pictures.combined())),
    Format("text in pictures of PDF", None, "there is no library that recognises text; pictures.install takes one"),
    Format("text in pictures", None, "there is no library that recognises text; pictures.install takes one"),
    Format("image metadata", lambda: reading.register([".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"], pictures.file())),
    Format("PNG layers", lambda: reading.register(".png", png.png)),
    Format("HTML with style sheets", css.install),
    Format("HTML with selectors", lambda: css.install(full=True)),
)


def install(*names: str) -> dict[str, str]:
    """Put the named formats, or all, in place; by name "" or why a format can't be had."""
    unknown = set(names) - {f.name for f in FORMATS}
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    said = {}
    for f in FORMATS:
        if not names or f.name in names:
            said[f.name] = f.missing
            if f.install:
                f.install()
    return said
