"""Pictures as files and inside PDF files: metadata, layers, and text by a recogniser that is plugged in.

No library that recognises text is assumed.  ``install`` takes one as a function, given the pictures of a file at once
and the languages; extraction runs in Arrow batches, so that it is called where the files are.  Faults of a picture or of the
recogniser lose what that picture would have given and no more; a PDF file whose text can't be read is not readable.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from veilmark.sources import metadata, pdf, pixels, png
from veilmark.sources.reading import Found, Limits, Segment, register

LEAST, MOST = 50, 200
LANGUAGE = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


@dataclass
class Picture:
    """A picture's pixels (rows of RGBA, None if not decoded) and its bytes (of a file, or packed samples)."""

    width: int
    height: int
    rgba: np.ndarray | None
    data: bytes


Recogniser = Callable[[list[Picture], str], list[str]]


def languages(said: str) -> str:
    """Codes joined by plus signs, checked."""
    if not isinstance(said, str) or not all(LANGUAGE.fullmatch(token) for token in said.split("+")):
        raise ValueError(f"languages must be codes joined by '+', not {said!r}")
    return said


def layers(rgba: np.ndarray | None) -> list[Segment]:
    """What a person doesn't see in it: wholly transparent pixels that hold a picture, and text of too little contrast."""
    return [s for s in (png.transparent(rgba), png.low_contrast(rgba)) if s] if rgba is not None and rgba.size else []


def recognised(pictures: list[Picture], recogniser: Recogniser | None, said: str) -> list[str]:
    """Each picture's text, empty where there is no recogniser or it fails; one that fails for all is asked for each."""
    if recogniser is None or not pictures:
        return [""] * len(pictures)
    try:
        texts = [t or "" for t in recogniser(pictures, said)]
        if len(texts) == len(pictures):
            return texts
    except Exception:  # noqa: BLE001  which picture it was is found out below
        pass
    out = []
    for one in pictures:
        try:
            out.append((recogniser([one], said) or [""])[0] or "")
        except Exception:  # noqa: BLE001  this picture's text is lost
            out.append("")
    return out


def file(recogniser: Recogniser | None = None, said: str = "eng") -> Callable[[bytes, Limits], list[Segment]]:
    """An extractor of picture files: metadata, then recognised text, then layers."""

    def extract(data: bytes, limits: Limits) -> list[Segment]:
        found = png.tagged(data) if data.startswith(b"\x89PNG") else metadata.image(data, limits)
        try:
            rgba = pixels.rgba(data)
        except Exception:  # noqa: BLE001  metadata stays
            rgba = None
        height, width = rgba.shape[:2] if rgba is not None else (0, 0)
        (text,) = recognised([Picture(width, height, rgba, data)], recogniser, said)
        return found + ([Segment(text, True, "body", "OCR")] if text.strip() else []) + layers(rgba)

    return extract


def _samples(file_: pdf.File, head: dict, body: bytes) -> np.ndarray | None:
    """RGBA of an image object of 8 bits a sample in a device's colour space, with its soft mask."""
    width, height = file_.get(head.get("Width"), 0), file_.get(head.get("Height"), 0)
    space = file_.get(head.get("ColorSpace"))
    palette = None
    if isinstance(space, list) and space and file_.get(space[0]) == "Indexed" and len(space) == 4:
        table = file_.get(space[3])
        table = table if isinstance(table, bytes) else file_.stream(space[3])
        base = {"DeviceGray": 1, "DeviceRGB": 3}.get(file_.get(space[1]))
        palette = np.frombuffer(table, np.uint8)[: len(table) // base * base].reshape(-1, base) if base else None
        n = 1
    else:
        n = {"DeviceGray": 1, "DeviceRGB": 3}.get(space) if isinstance(space, str) else None
    if n is None or (isinstance(space, list) and palette is None) or file_.get(head.get("BitsPerComponent"), 8) != 8 or len(body) < width * height * n:
        return None
    rows = np.frombuffer(body[: width * height * n], np.uint8).reshape(height, width, n)
    if palette is not None:
        rows = palette[np.minimum(rows[:, :, 0], len(palette) - 1)]
    out = np.full((height, width, 4), 255, np.uint8)
    out[:, :, :3] = rows
    mask = head.get("SMask")
    own = file_.get(mask)
    if isinstance(own, dict) and (file_.get(own.get("Width")), file_.get(own.get("Height"))) == (width, height):
        alpha = file_.stream(mask)
        if len(alpha) >= width * height:
            out[:, :, 3] = np.frombuffer(alpha[: width * height], np.uint8).reshape(height, width)
    return out


def inside(file_: pdf.File) -> Iterator[tuple[int, int, Picture]]:
    """(page, number on it, picture) of a PDF file's pictures, in order; equal ones once, small ones not, at most MOST."""
    seen, n = set(), 0
    for page_no, page in enumerate(file_.pages(), 1):
        resources = [page.get("Resources"), *(file_.get(v).get("Resources") for _, v in file_.forms(page.get("Resources")))]
        entries = [v for own in resources for v in file_.named(own, "XObject").values() if isinstance(file_.get(v), dict) and file_.get(v).get("Subtype") == "Image"]
        for number, value in enumerate(entries, 1):
            head = file_.get(value)
            width, height = file_.get(head.get("Width"), 0), file_.get(head.get("Height"), 0)
            if not all(isinstance(x, int) and x >= LEAST for x in (width, height)) or width * height > pixels.MOST:
                continue
            try:
                body = file_.stream(value)
                rgba = _samples(file_, head, body)
            except Exception:  # noqa: BLE001  a filter for pictures: its bytes are what there is
                body, rgba = file_.objects[int(value)][1] if isinstance(value, pdf.Ref) else b"", None
            digest = hashlib.sha256(rgba.tobytes() if rgba is not None else body).digest()
            if digest in seen:
                continue
            seen.add(digest)
            yield page_no, number, Picture(width, height, rgba, body)
            n += 1
            if n == MOST:
                return


def combined(recogniser: Recogniser | None = None, said: str = "eng") -> Callable[[bytes, Limits], list[Segment]]:
    """An extractor of PDF files: their text, which must be readable, then what their pictures give, which may fail."""

    def extract(data: bytes, limits: Limits) -> list[Segment]:
        found = pdf.pdf(data, limits)
        counts = getattr(found, "counts", {})
        more: list[Segment] = []
        try:
            every = list(inside(pdf.File(data)))
            texts = recognised([p for _, _, p in every], recogniser, said)
            for (page, number, picture), text in zip(every, texts):
                label = f"page {page}, image #{number} ({picture.width}x{picture.height})"
                more += [Segment(s.text, False, "css_hidden", f"{label} [{s.location}]") for s in layers(picture.rgba)]
                if text.strip():
                    more.append(Segment(text, True, "body", f"{label} [OCR]"))
                try:
                    own = metadata.image(picture.data, limits) if picture.rgba is None else []
                except Exception:  # noqa: BLE001  no metadata then
                    own = []
                more += [Segment(s.text, False, s.kind, f"{label} [{s.location}]") for s in own]
        except Exception:  # noqa: BLE001  pictures must not bury the text
            pass
        whole = Found(*found, *more)
        whole.counts = counts
        return whole

    return extract


def install(recogniser: Recogniser | None = None, said: str = "eng") -> None:
    """Take picture files and PDF files with this recogniser, and these languages, from now on."""
    said = languages(said)
    register([".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"], file(recogniser, said))
    register(".pdf", combined(recogniser, said))


register([".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp"], file())
