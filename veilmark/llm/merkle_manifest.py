"""A Merkle manifest of a dataset: a digest for each row, a tree for each source, one root over all of them.

Method.  The elements of an associative monoid are sparse forests: nodes keyed by (tree, level, index) whose run of siblings
is not whole yet.  Adding two forests unites their nodes; as soon as a run has all its siblings (how many is known from
the tree's size) they become their parent, which may complete the next run.  Each task folds its rows into such a forest and
writes down completed runs at once; forests of ``FAN`` neighbouring ranges are added in rounds (a tree reduction), so what a
task still holds are the nodes at the edges of its range: at most ``FAN`` a level, side and range.  The subroots of all
trees, in order, are the leaves of one more tree made the same way.

Scale.  Texts are read once, for their leaves; only leaves (a key and 32 bytes) are sorted, by range over (tree, id), so a
source of a third of all rows spreads over all tasks.  Positions come from the ranges' offsets, a row for each range and
source in it.  The tree reduction writes each round to the shared folder and never passes through the driver: that learns the
root, the greatest size and the number of ranges.  Proofs are handed down from the roots by joins of a run with its parent's,
a sixteenth as many rows a level; one row meets one run, so no key is hot.

Defined cases.  A null column is ``-`` in its row's leaf; a null source is a tree of its own, the first; null ids come first.
Rows of one id are ordered by their leaves, so repeated rows are leaves each and reruns agree.  A tree of one row has its leaf
as subroot, and a dataset of one source its subroot as root.  An empty table has no root and gives no rows.  A very long text
is one value of the digest function.  Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import staging

#: So many siblings make a run.  Forests of so many ranges are added at once.
BITS = 4
FAN = 1 << BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_FOREST = "part int, kind string, tree string, size long, level int, index long, digest binary, children array<binary>"
_NAMES = ("part", "kind", "tree", "size", "level", "index", "digest", "children")
_TYPES = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
_PATH = "array<struct<place:int,run:array<binary>>>"


def leaf(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, instead: Mapping[str, Column] | None = None) -> Column:
    """The digest of a row: of each column's byte count, a colon and its value, or ``-``."""
    said = []
    for name in columns:
        value = (instead or {}).get(name, docs[name]).cast("string")
        said.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*said), 256))


class Forest:
    """Runs of siblings that are not whole, of any trees; ``done`` is told of what becomes whole."""

    def __init__(self, done: callable) -> None:
        self.open: dict[tuple[str, int, int, int], dict[int, bytes]] = {}
        self.done = done

    def add(self, tree: str, size: int, level: int, index: int, digest: bytes) -> None:
        while True:
            width = -(-size >> BITS * level)  # how many nodes this level of the tree has
            if width == 1:
                self.done("root", tree, size, level, 0, digest, None)
                return
            key = (tree, size, level, index >> BITS)
            run = self.open.setdefault(key, {})
            run[index & FAN - 1] = digest
            if len(run) < min(FAN, width - (key[3] << BITS)):
                return
            del self.open[key]
            children = [run[place] for place in range(len(run))]
            level, index, digest = level + 1, key[3], sha256(b"".join(children).hex().encode()).digest()
            self.done("run", tree, size, level - 1, index, digest, children)

    def rows(self) -> Iterator[tuple]:
        for (tree, size, level, run), nodes in self.open.items():
            for place, digest in nodes.items():
                yield "open", tree, size, level, (run << BITS) + place, digest, None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], list(_NAMES))


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves in order (part, tree, size, index, digest) to whole runs, roots and what stays open.

    A forest is of one range of the sort; ranges that a task reads after each other are forests of their own.
    """
    made: list[tuple] = []
    part = None
    forest = Forest(lambda *row: made.append((part, *row)))
    for batch in batches:
        for own, tree, size, index, digest in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if own != part:
                made += [(part, *row) for row in forest.rows()]
                forest.open.clear()
                part = own
            forest.add(tree, size, 0, index, digest)
        if made:
            yield _table(made)
            made.clear()
    yield _table([(part, *row) for row in forest.rows()])


def _added(table: pa.Table) -> pa.Table:
    """Open nodes of neighbouring ranges, added up."""
    made: list[tuple] = []
    part = table.column("part")[0].as_py()
    forest = Forest(lambda *row: made.append((part, *row)))
    for row in zip(*(table.column(n).to_pylist() for n in ("tree", "size", "level", "index", "digest"))):
        forest.add(*row)
    return pa.Table.from_batches([_table(made + [(part, *row) for row in forest.rows()])])


@dataclass
class Grown:
    """Trees: ``leaves`` (tree, size, index and the given columns), ``runs`` (tree, size, level, index of the parent, digest,
    children), ``roots`` (tree, digest), and how many levels of runs the highest tree has."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame
    levels: int


def grow(leaves: DataFrame, order: list[Column], digest: str = "digest") -> Grown | None:
    """A tree over the rows of each ``tree`` (a string that isn't null) in that order; None where there are no rows."""
    ordered = leaves.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ordered = staging.stage(ordered.withColumn("part", F.shiftright("at", 33).cast("int")), "ordered")
    pieces = ordered.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of_tree = Window.partitionBy("tree")
    pieces = staging.stage(pieces.select("part", "tree", "first", (F.sum("n").over(of_tree.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(of_tree).alias("size")), "pieces")
    parts, most = pieces.agg(F.max("part"), F.max("size")).first()
    if most is None:
        return None
    placed = ordered.join(pieces, ["part", "tree"]).withColumn("index", F.col("before") + F.col("at") - F.col("first")).drop("at", "first", "before")
    made = [staging.stage(placed.select("part", "tree", "size", "index", digest).sortWithinPartitions("part", "tree", "index").mapInArrow(_planted, _FOREST), "forest")]
    while parts is not None:  # once at least: a range may have been read by several tasks
        parts = parts >> BITS or None
        near = made[-1].filter("kind = 'open'").withColumn("part", F.shiftright("part", BITS))
        made.append(staging.stage(near.groupBy("part").applyInArrow(_added, _FOREST), "forest"))
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    levels = 0
    while most > 1:
        most, levels = -(-most >> BITS), levels + 1
    return Grown(placed.drop("part"), whole.filter("kind = 'run'").drop("part", "kind"), whole.filter("kind = 'root'").select("tree", "digest"), levels)


def paths(grown: Grown, above: DataFrame | None = None) -> DataFrame:
    """grown.leaves with ``path``, the runs from the leaf's own to the last, each with the place in it, and the columns of above.

    ``above`` has, for each tree, the path on from its root, ``up``, and any other columns; without it paths end at the roots.
    """
    known = [c for c in above.columns if c not in ("tree", "up")] if above is not None else []
    onward = lambda rows: rows.withColumn("up", F.array().cast(_PATH)) if above is None else rows.join(above, "tree")
    full = None
    for level in reversed(range(grown.levels)):
        own = grown.runs.filter(F.col("level") == level)
        last = F.col("size") <= 1 << BITS * (level + 1)
        found = onward(own.filter(last)).select("tree", "index", "children", "up", *known)
        if full is not None:
            parent = full.select("tree", F.col("index").alias("parent"), F.col("children").alias("run"), F.col("up").alias("on"), *known)
            inner = own.filter(~last).withColumn("parent", F.shiftright("index", BITS)).join(parent, ["tree", "parent"])
            found = found.unionByName(inner.select("tree", "index", "children", _step("index", "run", "on").alias("up"), *known))
        full = found
    alone = onward(grown.leaves.filter("size = 1")).withColumnRenamed("up", "path")
    if full is None:
        return alone
    runs = full.select("tree", F.col("index").alias("parent"), F.col("children").alias("run"), "up", *known)
    inside = grown.leaves.filter("size > 1").withColumn("parent", F.shiftright("index", BITS)).join(runs, ["tree", "parent"])
    return inside.withColumn("path", _step("index", "run", "up")).drop("parent", "run", "up").unionByName(alone)


def _step(index: str, run: str, on: str) -> Column:
    place = F.col(index).bitwiseAND(FAN - 1).cast("int")
    return F.concat(F.array(F.struct(place.alias("place"), F.col(run).alias("run"))), F.col(on))


def _hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def siblings(path: Column) -> Column:
    """The proof: the digests of the run's others, level by level, as one hex text."""
    return F.array_join(F.transform(path, lambda p: _hex(F.filter(p["run"], lambda d, i: i != p["place"]))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along the path, in binary."""
    def up(below: Column, p: Column) -> Column:
        return F.unhex(F.sha2(_hex(F.transform(p["run"], lambda d, i: F.when(i == p["place"], below).otherwise(d))), 256))

    return F.aggregate(path, digest, up)


@dataclass
class Manifest:
    """``root`` in hex; ``sources``, the trees' subroots; ``proofs``: a row per row with its leaf, subroot and path; ``runs``, all runs."""

    root: str
    sources: DataFrame
    runs: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source: str = "source", also: Mapping[str, Column] | None = None) -> Manifest | None:
    """The manifest of docs, with the columns ``also`` carried beside each leaf; None for an empty table."""
    tree = F.when(docs[source].isNull(), "0").otherwise(F.concat(F.lit("1"), docs[source].cast("string")))
    leaves = staging.stage(docs.select(tree.alias("tree"), docs[id_col].alias("id"), leaf(docs, columns).alias("digest"), *(c.alias(n) for n, c in (also or {}).items())), "digests")
    grown = grow(leaves, [F.col("id").asc_nulls_first(), F.col("digest")])
    if grown is None:
        return None
    subroots = grown.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = grow(subroots, [F.col("of")])
    root = bytes(top.roots.first()["digest"])
    sources = staging.stage(paths(top).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("up")), "sources")
    proofs = paths(grown, sources)
    return Manifest(root.hex(), sources, grown.runs, proofs)


def verified(made: Manifest, digest: Column | str = "digest") -> DataFrame:
    """The proofs with ``folded``, what these digests lead to, and whether that is the manifest's root."""
    digest = F.col(digest) if isinstance(digest, str) else digest
    return made.proofs.withColumn("folded", F.lower(F.hex(folded(digest, F.col("path"))))).withColumn("verified", F.col("folded") == made.root)


def report(docs: DataFrame, folds: int = 5) -> DataFrame:
    """A row per document, with what a lower-cased text of every fifth document does to its root."""
    fifth = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0
    upper = "".join(map(chr, range(65, 91)))
    shown = F.when(fifth, leaf(docs, instead={"text": F.translate(docs["text"], upper, upper.lower())})).otherwise(leaf(docs))
    made = manifest(docs, also={"shown": shown})
    if made is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    hexed = lambda c: F.lower(F.hex(c))
    return verified(made, "shown").select(
        F.col("id").alias("doc_id"), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(made.root).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified",
    )
