"""The training-data pipeline: documents in, decided and encoded documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  A stage frees what this thread's stage before it over the same
folder staged: by contract that one's result has been written.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import bpe_codec, jaccard_join, language_id, mixture, staging, stream_dedup
from veilmark.sources import reading

#: No SQL can express the language model, the similarity join or the encoder; tests hold run() against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_staged: dict[tuple[int, str], staging.Folders] = {}


def _stage(made: Callable[[DataFrame], DataFrame]) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folders = _staged.setdefault((get_ident(), sf_dir), [])
        staging.release(folders)
        with staging.owned(folders):
            return made(docs)

    return run


#: Documents whose language is rejected go; lang is the predicted one from here on.
identify_language = _stage(language_id.keep)
#: Of equal texts the row of the largest id stays.
exact_dedup = _stage(stream_dedup.keep)
#: One document of each group of near copies (five words, a similarity of 0.8) stays: that of the smallest id.
near_dedup = _stage(jaccard_join.keep)
#: The mixture: documents as often as they are taken, the last one of a shard with just its taken words.
mix_sources = _stage(lambda docs: mixture.sample(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
#: Token ids of each row of the mixture, with its language and source, counts and digests.
encode = _stage(lambda docs: bpe_codec.encode(docs, carry=("lang", "source")))

STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reading.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before: staging.Folders = []
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with staging.owned([]) as written:
            path = staging.folder(spark, name.replace(" ", "-"))
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        staging.release(before)
        before = written
    encoded = STAGES[-1][1](spark, docs, sf_dir)
    _staged.pop((get_ident(), sf_dir), None)  # what it hangs on stays until the driver ends
    return encoded
