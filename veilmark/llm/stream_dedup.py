"""Exact deduplication as a stateful stream.

Method.  Every row becomes a feed record: a SHA-256 digest of its whole text, its identifier, and a locator of the
content (file and row in it).  A Structured Streaming aggregation folds the feed into keyed state held on disk
(RocksDB), with no watermark and so no expiry: per digest the identifier and locator of the row that stays, and the
group's size.  Only digests that were hit more than once are looked at again: the full bytes of all their texts are
compared, and should two texts share a digest they are told apart by their bytes.

Scale.  The feed carries no text.  State updates are combined map-side, so a digest that holds a third of all rows
reaches its state partition as one record per task.  The byte comparison is a min/max aggregation with the same
combine.  The table of hit digests is broadcast only below ``BROADCAST_ROWS``; beyond that it is a shuffled join,
whose skew adaptive execution splits.

Defined cases.  A null text counts as the empty text.  Of equal texts the largest doc_id stays; a null doc_id is
below all others, and among rows of one doc_id the largest locator stays, so exactly one row of a group is kept.
An empty table gives no rows.  A very long text is one value of the digest function, and of the comparison.  Extra columns, whatever their names, are carried through ``keep`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import staging

#: Up to this many hit digests (about 200 bytes each) the lookup side is broadcast.
BROADCAST_ROWS = 100_000

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _located(docs: DataFrame, text: str) -> tuple[DataFrame, Column, Column]:
    """docs with a locator for each row; docs that are no direct read of files are staged first."""
    try:
        where = docs.metadataColumn("_metadata")
        docs.select(where["row_index"]).schema  # noqa: B018  resolved eagerly, without running
    except AnalysisException:
        docs = staging.stage(docs, "located")
        where = docs.metadataColumn("_metadata")
    return docs, F.struct(where["file_path"].alias("file"), where["row_index"].alias("row")), F.coalesce(docs[text], F.lit(""))


def fold(feed: DataFrame, bytes_per_trigger: int | None = None, files_per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the feed (columns digest, doc_id, locator) through the keyed state and return the state's groups.

    With a ``checkpoint`` of an earlier call, only files that it has not seen are read, and its state is continued.
    """
    spark = feed.sparkSession
    path = feed.inputFiles()[:1] and feed.inputFiles()[0].rpartition("/")[0]
    if not path:
        return spark.createDataFrame([], f"digest string, keeper struct<doc_id:{feed.schema['doc_id'].dataType.simpleString()},locator:struct<file:string,row:bigint>>, group_size bigint")
    source = spark.readStream.schema(feed.schema)
    if bytes_per_trigger:
        source = source.option("maxBytesPerTrigger", bytes_per_trigger)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    groups = source.parquet(path).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    checkpoint = checkpoint or staging.folder(spark, "state")
    with _configured(spark, _STATE_CONF):
        run = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        keeper, size = (F.col("value")[f.name] for f in state.schema["value"].dataType.fields)
        return staging.stage(state.select(F.col("key.digest").alias("digest"), keeper.alias("keeper"), size.alias("group_size")).filter("group_size > 1"), "hits")


def _looked_up(rows: DataFrame, hits: DataFrame, n_hits: int, on: list[str], how: str) -> DataFrame:
    return rows.join(F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits, on, how)


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = 16 << 30, files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(feed, hits): a record per row, and the groups of more than one row, told apart by bytes.

    ``feed`` has digest, doc_id and locator; ``hits`` has digest, text (null unless a digest is shared by different
    texts), keeper and group_size.
    """
    docs, locator, content = _located(docs, text)
    feed = staging.stage(docs.select(digest(content).alias("digest"), docs[id_col].alias("doc_id"), locator.alias("locator")), "feed")
    hits = fold(feed, bytes_per_trigger, files_per_trigger).withColumn("text", F.lit(None).cast("string"))
    n_hits = hits.count()
    if not n_hits:
        return feed, hits
    members = _looked_up(docs.select(digest(content).alias("digest"), content.alias("text"), docs[id_col].alias("doc_id"), locator.alias("locator")), hits.select("digest"), n_hits, ["digest"], "left_semi")
    unequal = staging.stage(members.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "unequal")
    n_unequal = unequal.count()
    if n_unequal:
        apart = _looked_up(members, unequal, n_unequal, ["digest"], "left_semi").groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        hits = staging.stage(_looked_up(hits, unequal, n_unequal, ["digest"], "left_anti").unionByName(apart), "apart")
    return feed, hits


def decisions(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, **stream: object) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    docs, locator, content = _located(docs, text)
    feed, hits = groups(docs, text, id_col, digest, **stream)
    n_hits, by_bytes = hits.count(), hits.filter("text is not null").limit(1).count()
    if by_bytes or digest is not sha256:
        feed = docs.select(digest(content).alias("digest"), docs[id_col].alias("doc_id"), locator.alias("locator"), content.alias("content"))
    else:
        feed = feed.withColumn("content", F.lit(None).cast("string"))
    hits = hits.withColumnRenamed("text", "hit_text")
    rows = feed.join(F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits, (feed["digest"] == hits["digest"]) & (hits["hit_text"].isNull() | (hits["hit_text"] == feed["content"])), "left").drop(hits["digest"])
    return rows.select(
        "doc_id",
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keeper").isNull() | (F.col("keeper.locator") == F.col("locator"))).alias("kept"),
        (F.col("digest") if digest is sha256 else F.sha2("content", 256)).alias("text_sha256"),
    )


def keep(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256, **stream: object) -> DataFrame:
    """docs without the rows that another row of the same text replaces; all columns as they were."""
    columns = docs.columns
    docs, locator, content = _located(docs, text)
    _, hits = groups(docs, text, id_col, digest, **stream)
    n_hits = hits.count()
    known, shared, keeper, own, place = staging.free(columns, "__digest", "__text", "__keeper", "__own_digest", "__own_locator")
    hits = hits.select(F.col("digest").alias(known), F.col("text").alias(shared), F.col("keeper.locator").alias(keeper))
    rows = docs.withColumns({own: digest(content), place: locator})
    same = (F.col(own) == F.col(known)) & (F.col(shared).isNull() | (F.col(shared) == F.coalesce(docs[text], F.lit(""))))
    rows = rows.join(F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits, same, "left").filter(F.col(keeper).isNull() | (F.col(keeper) == F.col(place)))
    return rows.select(*(docs[c] for c in columns))


def report(docs: DataFrame) -> DataFrame:
    return decisions(docs)

