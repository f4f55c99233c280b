"""Extra columns with the names that operators use inside keep their values and break nothing."""

from __future__ import annotations

import pathlib
import re

import pytest

import corpus_pipeline
import veilmark.llm
from veilmark.llm import registry

NAMES = sorted({m for f in pathlib.Path(veilmark.llm.__file__).parent.glob("*.py") for m in re.findall(r'"(_*[a-z][a-z_0-9]{0,24})"', f.read_text())} - {"doc_id", "text", "lang", "source", "n_chars", "vec_id", "embedding", "conv_id", "turn", "role", "toxic"})


def clashing(spark, repeated):
    word = ["the", "of", "and", "house", "with", "river", "stone", "light", "paper", "green"]
    rows = [(i if not repeated else i // 2, " ".join(word[(i * k + k * k // 3) % 10] for k in range(1, 40)) + f" w{i}", "en", f"s{i % 2}", i) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s0", 1), (21, None, None, None, None)] + ([(None, "the of and", "en", "s1", 3)] if repeated else [])
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *(base["text"].substr(1, 5).alias(n) for n in NAMES))


@pytest.mark.parametrize("repeated", [False, True])
def test_stages_carry_every_column(spark, tmp_path, repeated):
    docs = clashing(spark, repeated)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns, name
        rows = made.collect()
        assert rows and all(r[n] == (r.text[:5] if r.text is not None else None) for r in rows for n in NAMES if r.text is None or len(r.text) > 5), name
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n[2:].split("_")[0] in ("1", "2", "3", "4", "6", "7", "8", "9", "10", "11")))
def test_queries_do_not_mind(spark, tmp_path, name):
    docs = clashing(spark, True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == docs.count()


def test_names_are_known():
    assert {"uid", "__uid", "digest", "keeper", "size"} <= set(NAMES) and len(NAMES) > 100
