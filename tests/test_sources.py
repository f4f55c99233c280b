from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilmark.functions import contract, detect
from veilmark.operators import geometry
from veilmark.sources import docx, html, reading
from veilmark.streaming import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LIMITS = reading.Limits()


def word(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def run(text: str, properties: str = "") -> str:
    return f"<w:r><w:rPr>{properties}</w:rPr><w:t>{text}</w:t></w:r>"


def concealed(properties: str, **parts: str) -> list[str | None]:
    return [s.concealment for s in docx.docx(word(f"<w:p>{run('secret text', properties)}</w:p>", **parts), LIMITS) if s.kind == "docx_hidden"]


def test_decode():
    assert reading.decode("é\r\nx\ry".encode()) == ("é\nx\ny", None)
    assert reading.decode(b"\xef\xbb\xbfabc") == ("abc", None)
    assert reading.decode("日本".encode("cp932")) == ("日本", "cp932")
    for bad in (b"\x81\x7f", "x".encode("utf-16"), "x".encode("utf-32")):
        with pytest.raises(reading.Refused):
            reading.decode(bad)


def test_html():
    page = '<p>seen</p>\n<div style="Display : none">a<b>hidden</b><br>x</div><p hidden>h2</p><script>var x</script><!-- a long comment here --><!-- short --><img alt="a long description"><p aria-hidden="true">q</p>'
    found = [(s.kind, s.visible, s.text, s.location) for s in html.html(page.encode(), LIMITS)]
    assert found == [
        ("body", True, "seen", "line 1"),
        ("css_hidden", False, "a", "line 2"), ("css_hidden", False, "hidden", "line 2"), ("css_hidden", False, "x", "line 2"),
        ("css_hidden", False, "h2", "line 2"), ("comment", False, "a long comment here", "line 2"),
        ("hidden_attr", False, "a long description", "line 2, <img> @alt"), ("css_hidden", False, "q", "line 2"),
    ]


def test_docx_reasons():
    assert concealed("<w:vanish/>") == ["vanish"]
    assert concealed('<w:vanish w:val="0"/>') == [] and concealed('<w:vanish w:val="maybe"/>') == []
    assert concealed('<w:sz w:val="2"/>') == ["tiny_font"] and concealed('<w:sz w:val="3"/>') == []
    for colour in ("FFFFFF", "ECECEC", "F2F2F2", "FFFF00"):
        assert concealed(f'<w:color w:val="{colour}"/>') == [f"low_contrast (fg={colour},bg=FFFFFF,src=default)"]
    for colour in ("EBEBEB", "D9D9D9", "00FFFF", "808080", "auto"):
        assert concealed(f'<w:color w:val="{colour}"/>') == []
    assert concealed('<w:color w:val="FFFFFF"/><w:highlight w:val="black"/>') == []
    assert concealed('<w:color w:val="FF0000"/><w:shd w:val="solid" w:color="FF0000"/>') == ["low_contrast (fg=FF0000,bg=FF0000,src=run_shading)"]
    styles = f'<w:styles {W}><w:style w:styleId="a"><w:rPr><w:vanish/></w:rPr></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/></w:style></w:styles>'
    assert concealed('<w:rStyle w:val="b"/>', word__styles=styles) == ["vanish"]
    circle = f'<w:styles {W}><w:style w:styleId="a"><w:basedOn w:val="a"/></w:style></w:styles>'
    with pytest.raises(reading.Refused, match="malformed_xml"):
        concealed('<w:rStyle w:val="a"/>', word__styles=circle)


def test_docx_paragraphs_and_parts():
    body = f"<w:p>{run('one ')}{run('hid', '<w:vanish/>')}{run('den', '<w:vanish/>')}{run(' two')}{run('gap', '<w:vanish/>')}</w:p><w:p><w:del><w:r><w:delText>gone text</w:delText></w:r></w:del></w:p>"
    notes = f'<w:footnotes {W}><w:footnote w:type="separator"><w:p>{run("a separator note")}</w:p></w:footnote><w:footnote><w:p>{run("a real footnote")}</w:p></w:footnote></w:footnotes>'
    head = f"<w:hdr {W}><w:p>{run('page head')}</w:p></w:hdr>"
    core = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:subject>a long subject line</dc:subject></c>'
    found = [(s.kind, s.text, s.location, s.concealment) for s in docx.docx(word(body, word__footnotes=notes, word__header1=head, docProps__core=core), LIMITS)]
    assert found == [
        ("body", "one  two", "paragraph 1", None), ("docx_hidden", "hidden", "paragraph 1", "vanish"), ("docx_hidden", "gap", "paragraph 1", "vanish"),
        ("docx_hidden", "gone text", "paragraph 2", "tracked_deletion"), ("header_footer", "page head", "header1 1", None),
        ("footnote", "a real footnote", "footnote #2", None), ("metadata", "a long subject line", "core.xml / dc:subject", None),
    ]


@pytest.mark.parametrize(
    ("parts", "limits", "code"),
    [
        ({"word__styles": "<w:styles"}, LIMITS, "malformed_xml"),
        ({"word__styles": "<styles/>"}, LIMITS, "unsupported_namespace"),
        ({"word__styles": f"<w:hdr {W}/>"}, LIMITS, "unsupported_namespace"),
        ({"word__styles": f"<!DOCTYPE x><w:styles {W}/>"}, LIMITS, "doctype_not_allowed"),
        ({"word__styles": f'<?xml version="1.0" encoding="latin-1"?><w:styles {W}/>'}, LIMITS, "unsupported_encoding"),
        ({"WORD__document": "<x/>"}, LIMITS, "duplicate_part"),
        ({}, reading.Limits(elements=2), "too_many_elements"),
        ({}, reading.Limits(part_bytes=20), "part_too_large"),
        ({}, reading.Limits(total_bytes=20), "total_too_large"),
        ({"a": "", "b": ""}, reading.Limits(entries=2), "too_many_entries"),
    ],
)
def test_docx_refusals(parts, limits, code):
    with pytest.raises(reading.Refused, match=code):
        docx.docx(word(f"<w:p>{run('x')}</w:p>", **parts), limits)


def test_limits_and_codes_are_closed():
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            reading.Limits(file_bytes=bad)
    with pytest.raises(ValueError):
        reading.Refused("because")


def test_extract_and_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("﻿plain")
    (tmp_path / "sub/b.html").write_text("<p style='opacity:0'>x</p>")
    (tmp_path / "sub/c.docx").write_bytes(b"no zip")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"x")
    found = reading.extract(reading.scan(spark, str(tmp_path)), reading.Limits(file_bytes=100))
    rows = {r.source.rsplit("/", 1)[1]: (r.status, r.mask, r.n) for r in found.select("source", "status", detect.observe(F.col("segments"), F.col("status"))["mask"].alias("mask"), F.size("segments").alias("n")).collect()}
    assert rows["a.TXT"] == ("ok", "1000-000", 1) and rows["b.html"] == ("ok", "1001-000", 1)
    assert rows["c.docx"] == ("Extraction failed: BadZipFile", "0000-000", 0)
    assert "d.bin" not in rows and rows["e.pdf"][1] == "0000-000"
    assert reading.extract(reading.scan(spark, str(tmp_path), recursive=False), reading.Limits(file_bytes=3)).filter("status = 'Extraction refused: file_too_large'").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("​" * 20)
    stream = files.watch(spark, str(tmp_path / "in"))
    run_ = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run_.awaitTermination()
    assert [r.mask for r in spark.table("seen").select("o.mask").collect()] == ["1100-001"]


def test_registry():
    reading.register("ABC", reading.plain)
    assert reading.registered(".abc") is reading.plain and reading.registered("nope") is None


@pytest.mark.parametrize(
    ("style", "rules"),
    [
        ("font-size:0.5px", ["font_size_tiny"]), ("font-size:0.51px", []), ("font-size:0.1em", []), ("FONT-SIZE: 0", ["font_size_tiny"]), ("font-size:-1px", []),
        ("opacity: 0.01", ["opacity_near_zero"]), ("opacity:1%", []), ("line-height:0", ["line_height_zero"]), ("line-height:0px", ["line_height_zero"]), ("line-height:0.5", []),
        ("transform:scale(0)", ["scale_collapse"]), ("transform:scaleX(0.005) rotate(3deg)", ["scale_collapse"]), ("transform:scale3d(1,1,0) scale(0)", ["scale_collapse"] * 2),
        ("transform:scale(0%)", []), ("transform:scale(1.5)", []), ("color:red;;opacity:0;bad", ["opacity_near_zero"]),
    ],
)
def test_geometry(spark, style, rules):
    assert [r.rule for r in geometry.inline(spark.createDataFrame([(style,)], "style string")).collect()] == rules


def test_thresholds():
    assert geometry.checked(geometry.THRESHOLDS) == geometry.THRESHOLDS
    for bad in ({}, geometry.THRESHOLDS | {"opacity_max": 1.5}, geometry.THRESHOLDS | {"scale_max": True}, geometry.THRESHOLDS | {"more": 1}):
        with pytest.raises(ValueError):
            geometry.checked(bad)


@pytest.mark.parametrize("source", ['﻿{}', '{"a":1,"a":2}', '{"a":NaN}', "[Infinity]", "{", '"' + "x" * (1 << 20) + '"'])
def test_strict_json_refuses(source):
    with pytest.raises(contract.ContractError):
        contract.parse_strict(source)


@pytest.mark.parametrize(
    ("value", "spec", "pointer"),
    [
        ({"a/b": 1}, {"type": "object", "keys": {"a/b": {"type": "string"}}}, "/a~1b"),
        ({}, {"type": "object", "keys": {"a": {"type": "string"}}}, "/a"),
        ({"x": 1}, {"type": "object"}, "/x"),
        (True, {"type": "integer"}, ""), (1, {"type": "boolean"}, ""), (float("nan"), {"type": "number", "min": 0}, ""),
        ([1, "a"], {"type": "array", "item_type": "integer"}, "/1"),
        (1.0, {"enum": [1]}, ""), ("ab", {"type": "string", "max_len": 1}, ""),
        ({"a": 1, "b": 2}, {"type": "object", "keys": {"a": {}, "b": {}}, "cross": {"mutually_exclusive": [["a", "b"]]}}, ""),
        (1, {"type": "integer", "nope": 1}, ""), (1, {"type": "integer", "min_len": 1}, ""), (1, {"validator": lambda v: 1 / 0}, ""),
    ],
)
def test_contract_refuses(value, spec, pointer):
    with pytest.raises(contract.ContractError) as e:
        contract.validate(value, spec)
    assert e.value.pointer == pointer


def test_contract_accepts():
    contract.validate({"a": [1, 2], "b": None}, {"type": "object", "keys": {"a": {"type": "array", "item_schema": {"type": "integer", "min": 1}, "min_len": 2}, "b": {"type": "null"}, "c": {"type": "string", "required": False}}})
    spec = {"type": "object", "keys": {"a": {"type": "object", "keys": {"a": {"type": "string"}}}}}
    deep: dict = {}
    for _ in range(50_000):
        deep = {"a": deep}
    with pytest.raises(contract.ContractError) as e:
        contract.validate(deep, spec)
    assert e.value.pointer == "/a/a"
