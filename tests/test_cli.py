from __future__ import annotations

import json

import pytest

from veilmark.__main__ import main
from veilmark.operators import geometry


@pytest.mark.parametrize(("command", "rows"), [("observe", 2), ("catalog", 1), ("control", 1), ("geometry", 1)])
def test_receipts(spark, tmp_path, command, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x" + "​" * 20 + " [INST]")
    (tmp_path / "in/b.html").write_text("<p style='opacity:0'>y</p>")
    assert main([command, str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows


def test_dashboard_and_wrong_calls(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("x")
    assert main(["dashboard", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert "1000-000" in (tmp_path / "out/index.html").read_text()
    assert ">a.md</td>" in (tmp_path / "out/pages/000000001.html").read_text()
    for wrong in (["observe"], ["observe", "a", "b", "c"], ["observe", "a", "b", "--as", "pdf"], ["none", "a", "b"]):
        assert main(wrong) == 1 and "python -m veilmark" in capsys.readouterr().err


def test_one_receipt_a_document(spark, tmp_path):
    """Files named as the documents, of each form; a second run leaves the same bytes."""
    (tmp_path / "in/s").mkdir(parents=True)
    (tmp_path / "in/s/a.txt").write_text("x​ [INST] é [/INST] and [INST]")
    (tmp_path / "in/b.html").write_text("<p style='opacity:0'>y</p>")
    (tmp_path / "in/c.txt").write_bytes(b"\xff\xfe\x00")
    told = {}
    for command, form in (("observe", "json"), ("observe", "text"), ("report", "html"), ("catalog", "json"), ("control", "json"), ("control", "text"), ("geometry", "json"), ("geometry", "text")):
        out = tmp_path / f"{command}-{form}"
        runs = []
        for _ in range(2):
            assert main([command, str(tmp_path / "in"), str(out), "--as", form]) == 0
            runs.append({str(f.relative_to(out)): f.read_bytes() for f in out.rglob("*") if f.is_file() and not f.name.startswith(".")})
        assert runs[0] == runs[1] and json.loads(runs[0].pop("_SUCCESS"))["files"] == len(runs[0])
        told[command, form] = {k: v.decode() for k, v in runs[0].items()}
    assert set(told["observe", "json"]) == {"s/a.txt.json", "b.html.json", "c.txt.json"}
    one = json.loads(told["observe", "json"]["s/a.txt.json"])
    assert list(one) == ["source", "mask", "h_states", "evidence", "diagnostics"] and one["mask"] == "1100-000" and one["h_states"]["H2"] == 1 and one["source"].endswith("/in/s/a.txt")
    assert "unsupported_encoding" in told["observe", "text"]["c.txt.txt"] and "U+200B" in told["report", "html"]["s/a.txt.html"]
    catalog = json.loads(told["catalog", "json"]["s/a.txt.json"])
    assert catalog["observations"] == [{"kind": "H2", "codepoint": "U+200B", "count": 1, "positions": [1]}] and set(told["catalog", "json"]) == {"s/a.txt.json", "b.html.json"}
    control = json.loads(told["control", "json"]["s/a.txt.json"])
    assert [(f["name"], f["offset"]) for f in control["findings"]] == [("llama_inst_start", 3), ("llama_inst_end", 12), ("llama_inst_start", 24)] and control["finding_count"] == 3
    assert json.loads(told["control", "json"]["b.html.json"])["findings"] == [] and "é [/INST]" in told["control", "json"]["s/a.txt.json"]
    assert [o["rule"] for o in json.loads(told["geometry", "json"]["b.html.json"])["observations"]] == ["opacity_near_zero"] and set(told["geometry", "text"]) == {"b.html.txt"}


def test_configs_and_pages(spark, tmp_path, capsys):
    (tmp_path / "in/s").mkdir(parents=True)
    (tmp_path / "in/a.html").write_text("<link rel=stylesheet href=s/b.css><p style='font-size:2px'>secret word</p>")
    (tmp_path / "in/s/b.css").write_text("p { line-height: 0 }")
    (tmp_path / "v.json").write_text(json.dumps({"patterns": [{"category": "c", "name": "n", "pattern": "secret"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"thresholds": geometry.THRESHOLDS | {"font_size_px_max": 3}}))
    (tmp_path / "bad.json").write_text(json.dumps({"thresholds": {}}))
    call = lambda command, *config: main([command, str(tmp_path / "in"), str(tmp_path / command), *config])
    assert call("control", str(tmp_path / "v.json")) == call("geometry", str(tmp_path / "t.json")) == call("report") == call("report", "--lang", "ja") == 0
    assert [r.name for r in spark.read.parquet(str(tmp_path / "control")).collect()] == ["n"]
    assert [(r.origin, r.rule) for r in spark.read.parquet(str(tmp_path / "geometry")).orderBy("part").collect()] == [("inline_style", "font_size_tiny"), ("linked_css", "line_height_zero")]
    assert "secret word" in (tmp_path / "report/a.html.html").read_text() and "書式による隠蔽" in (tmp_path / "report/a.html.html").read_text()
    assert main(["geometry", str(tmp_path / "in"), str(tmp_path / "x"), str(tmp_path / "bad.json")]) == 1
    assert "text in pictures" in capsys.readouterr().err
