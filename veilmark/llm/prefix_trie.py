"""A prefix trie of conversations, with what sharing prefixes saves.

Method.  A conversation is an array of turns, each known by 128 bits of a SHA-256 digest of its role and text.  The arrays
are sorted by range over the whole table (array, then identifier); the longest common prefix of neighbours says which nodes end
and which begin between them, so one sweep with a stack yields every node of the trie with its counts when it is popped: a
node's members are an interval of the sorted arrays.  Nodes that reach over the edge of a range stay on open stacks: the
path shared with what comes before, and the one shared with what comes after.  Open stacks of neighbouring ranges are
stitched depth by depth (an associative addition) in rounds of ``FAN``; what no longer reaches an edge is closed then.

Scale.  Turns are shuffled once as digests of 16 bytes; texts are read once and not shuffled.  The sort is dealt by (array,
identifier), so equal conversations spread over tasks, as do those that share a first turn.  A sweep holds one path.  What
stitching reads are two paths for each range.  A node whose parent closes only in stitching gets its parent's identifier by a
join on (range, parent), whatever many children it has.  The digest of a node's members is of a text of any length: a node inside
one range feeds it as the sweep goes; one over an edge writes pieces of at most ``PIECE`` identifiers, which one task per
node feeds in order, holding a piece at a time, since SHA-256 has no parts that could be added up.  One conversation's array
of digests is one value: 16 MB for a million turns.

Defined cases.  Null roles and texts are empty ones.  Null turns come first; turns of one number are ordered by digest.  Rows
without a conv_id belong to no conversation.  A conversation of no turns is a member of the root.  An empty table has no nodes.  Repeated
rows are turns each.  Very long texts are one value of the digest function.  Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import staging

WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Open stacks of so many neighbouring ranges are stitched at once.
FAN = 64
PIECE = 10_000
_NODE = "kind string, part int, side string, depth int, id binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, piece string, at long"
_FIELDS = [f.split() for f in _NODE.split(", ")]
_NAMES = [n for n, _ in _FIELDS]
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in _FIELDS])
ROOT = sha256(b"").digest()[:WIDTH]
EMPTY = sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) pairs apart; null counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def sequences(turns: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation: conv_id, turns (array of digest and words) in order."""
    own = turns.select(turns[id_col].cast("long").alias("conv_id"), F.struct(turns[turn].alias("turn"), turn_digest(turns[role], turns[text]).alias("digest"), F.regexp_count(F.coalesce(turns[text], F.lit("")), F.lit(WORD)).alias("words")).alias("t"))
    said = own.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return said.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].cast("int").alias("words"))))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4, **columns: str) -> DataFrame:
    """Conversations that begin as the first of their block does, for as many turns as their identifier's checksum says."""
    own = staging.stage(sequences(turns, **columns), "sequences")
    first = own.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % block, "h": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")})
    joined = own.join(first, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(own.schema["turns"].dataType))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """How many whole digests two arrays share from the start: doubled steps, then halved ones."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    low, step = 0, 1
    while low + step <= most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
        low, step = low + step, step * 2
    while step:
        if low + step <= most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
            low += step
        step //= 2
    return low


class Node:
    """What is known of a node: of its closed children and its own ends; ``left`` and ``right`` say over which edges it reaches."""

    __slots__ = ("depth", "id", "words", "left", "right", "n", "least", "children", "leaves", "saved", "sha", "ends", "waiting", "many")

    def __init__(self, depth: int, id: bytes, words: int, left: bool = False, right: bool = False) -> None:
        self.depth, self.id, self.words, self.left, self.right = depth, id, words, left, right
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.sha, self.ends, self.waiting, self.many = None, [], [], False

    def take(self, other: Node) -> None:
        """Another part of the same node."""
        self.n, self.children, self.leaves, self.saved = self.n + other.n, self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.met(other.least)

    def met(self, least: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def closed(self, parent: Node | None) -> None:
        """Nothing more comes: the totals of the subtree, told to the parent."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        if parent is not None:
            parent.n, parent.children, parent.leaves, parent.saved = parent.n + self.n, parent.children + 1, parent.leaves + self.leaves, parent.saved + self.saved
            parent.met(self.least)

    def row(self, kind: str, part: int, side: str | None = None, parent: Node | None = None, ends: str | None = None) -> dict:
        known = parent.least if parent is not None and not (parent.left or parent.right) else None
        return {
            "kind": kind, "part": part, "side": side, "depth": self.depth, "id": self.id, "parent": parent.id if parent is not None and known is None else None, "conv_id": self.least, "parent_conv_id": known,
            "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved, "words": self.words, "ends_sha256": ends,
        }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


class Sweep:
    """Sorted arrays of one range, one after the other; rows of closed nodes, open ones and their members gather in ``made``."""

    def __init__(self, part: int, last: bytes, before: int, after: int) -> None:
        self.part, self.last, self.before, self.after = part, last, before, after
        self.stack: list[Node] = []
        self.made: list[dict] = []
        self.key: bytes | None = None

    def add(self, key: bytes, words: list[int], conv_id: int) -> None:
        if self.key is None:
            shared, first = -1, True
        else:
            shared, first = common(self.key, key), False
            self.pop(shared)
        depth = len(key) // WIDTH
        if depth > shared:
            ahead = min(self.after, common(key, self.last))
            digest = sha256(key[: max(shared, 0) * WIDTH])
            for d in range(shared + 1, depth + 1):
                if d:
                    digest.update(key[(d - 1) * WIDTH : d * WIDTH])
                self.stack.append(Node(d, digest.digest()[:WIDTH], words[d - 1] if d else 0, first and d <= self.before, d <= ahead))
        self.key = key
        top = self.stack[-1]
        top.n += 1
        top.met(conv_id)
        top.ends.append(str(conv_id))
        if len(top.ends) >= PIECE:
            self.flush(top)

    def flush(self, node: Node) -> None:
        if not node.ends:
            return
        said = ",".join(node.ends)
        if node.left or node.right:
            self.made.append({"kind": "piece", "part": self.part, "id": node.id, "piece": said, "at": int(node.ends[0])})
        else:
            if node.sha is None:
                node.sha = sha256(said.encode())
            else:
                node.sha.update(b"," + said.encode())
        node.ends = []

    def pop(self, depth: int) -> None:
        """Take off what is deeper than depth."""
        while len(self.stack) - 1 > depth:
            node = self.stack.pop()
            parent = self.stack[-1] if self.stack else None
            self.flush(node)
            if node.left or node.right:
                self.made.append(node.row("open", self.part, "lr"[node.right] if node.left != node.right else "b", parent))
                continue
            node.closed(parent)
            ends = node.sha.hexdigest() if node.sha else EMPTY
            if parent is None or parent.left or parent.right:
                self.made.append(node.row("node", self.part, None, parent, ends))
                self.told(node)
            else:  # the parent's least member is known when it is popped
                parent.waiting.append(node.row("node", self.part, None, None, ends))
                self.told(node)
                if len(parent.waiting) >= PIECE:  # it is looked up later
                    self.made += [row | {"parent": parent.id} for row in parent.waiting]
                    parent.waiting, parent.many = [], True

    def told(self, node: Node) -> None:
        for row in node.waiting:
            row["parent_conv_id"] = node.least
        self.made += node.waiting
        node.waiting = []
        if node.many:
            self.made.append(node.row("many", self.part))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, last, before, after, key, words, conv_id) in order; a task may read several ranges, one after the other."""
    sweep = None
    for batch in batches:
        for part, last, before, after, key, words, conv_id in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if sweep is None or sweep.part != part:
                if sweep is not None:
                    sweep.pop(-1)
                    yield _batch(sweep.made)
                sweep = Sweep(part, last, before, after)
            sweep.add(key, words, conv_id)
        if sweep is not None and sweep.made:
            yield _batch(sweep.made)
            sweep.made = []
    if sweep is not None:
        sweep.pop(-1)
        yield _batch(sweep.made)


class Stacks:
    """The open paths of a stretch of ranges: ``left`` and ``right`` by depth; the first ``both`` of each are the same nodes."""

    def __init__(self, left: list[Node], right: list[Node], both: int) -> None:
        self.left, self.right, self.both = left, right, both

    def stitch(self, after: Stacks, part: int, made: list[dict]) -> Stacks:
        """The stretch with the next one: the right path here and the left one there are the same nodes."""
        for mine, other in zip(self.right, after.left):
            mine.take(other)
        for depth in reversed(range(len(self.right))):
            node = self.right[depth]
            node.left, node.right = depth < self.both, depth < after.both
            parent = self.right[depth - 1] if depth else None
            if not node.left and not node.right:
                node.closed(parent)
                made.append(node.row("node", part) | {"parent": parent.id if parent else None})  # the parent's least member may not be known yet
        return Stacks(self.right[: self.both] + self.left[self.both :], self.right[: after.both] + after.right[after.both :], min(self.both, after.both))


def _stitched(table: pa.Table) -> pa.Table:
    """Open nodes of FAN neighbouring ranges (``at``: the range before this round) to closed ones and what stays open."""
    stacks: dict[int, dict[str, dict[int, Node]]] = {}
    part = table.column("part")[0].as_py()
    for r in table.to_pylist():
        node = Node(r["depth"], r["id"], r["words"])
        node.n, node.least, node.children, node.leaves, node.saved = r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"]
        stacks.setdefault(r["at"], {"l": {}, "r": {}, "b": {}})[r["side"]][node.depth] = node
    made: list[dict] = []
    whole: Stacks | None = None
    for at in sorted(stacks):
        own = stacks[at]
        path = lambda side: [n for _, n in sorted({**own["b"], **own[side]}.items())]  # noqa: B023, E731
        one = Stacks(path("l"), path("r"), len(own["b"]))
        whole = one if whole is None else whole.stitch(one, part, made)
    for side, nodes in (("b", whole.left[: whole.both]), ("l", whole.left[whole.both :]), ("r", whole.right[whole.both :])):
        made += [n.row("open", part, side) for n in nodes]
    return pa.Table.from_batches([_batch(made)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (id, piece), in order, to a digest for each id."""
    own, digest = None, None
    schema = pa.schema([("id", pa.binary()), ("sha", pa.string())])
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if id != own:
                if own is not None:
                    done.append((own, digest.hexdigest()))
                own, digest = id, sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield pa.RecordBatch.from_pylist([{"id": i, "sha": s} for i, s in done], schema=schema)
    if own is not None:
        yield pa.RecordBatch.from_pylist([{"id": own, "sha": digest.hexdigest()}], schema=schema)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, turns: array of digest and words): a row per distinct prefix, the root included."""
    spark = conversations.sparkSession
    flat = conversations.select(F.coalesce(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), F.lit("")).alias("hex"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id")
    flat = staging.stage(flat.select(F.unhex("hex").alias("key"), "words", "conv_id"), "arrays")
    ordered = staging.stage(flat.orderBy("key", "conv_id").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33).cast("int")), "ordered")
    edges = ordered.groupBy("part").agg(F.min("key").alias("head"), F.max("key").alias("last"))  # a row for each range
    turn = Window.orderBy("part")
    edges = edges.select("part", "last", _shared(F.lag("last").over(turn), F.col("head")).alias("before"), _shared(F.col("last"), F.lead("head").over(turn)).alias("after"))
    edges = staging.stage(edges, "edges")
    parts = edges.agg(F.max("part")).first()[0]
    if parts is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = ordered.join(F.broadcast(edges), "part").repartitionByRange(staging.tasks(spark), "part").sortWithinPartitions("part", "at")  # a range isn't read by two tasks
    rows = rows.select("part", "last", "before", "after", "key", "words", "conv_id")
    swept = staging.stage(rows.mapInArrow(_swept, _NODE), "swept")
    opened, closed = swept.filter("kind = 'open'"), []
    now = opened
    while parts:
        parts //= FAN
        near = now.withColumn("at", F.col("part").cast("long")).withColumn("part", (F.col("part") / FAN).cast("int"))
        now = staging.stage(near.groupBy("part").applyInArrow(_stitched, _NODE), "stitched")
        closed.append(now.filter("kind = 'node'"))
        now = now.filter("kind = 'open'")
    within = swept.filter("kind = 'node'")
    columns = [c for c in _NAMES if c != "part"]
    there = swept.filter("kind = 'many'").select("part", F.col("id").alias("parent"), F.col("conv_id").alias("found"))
    whole = within.filter("parent is null").select(columns)
    if closed:
        late = closed[0]
        for more in closed[1:]:
            late = late.unionByName(more)
        pieces = swept.filter("kind = 'piece'").select("id", "piece", "at", "part").repartition(staging.tasks(spark), "id").sortWithinPartitions("id", "part", "at")
        late = late.drop("ends_sha256").join(pieces.select("id", "piece").mapInArrow(_hashed, "id binary, sha string"), "id", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha")
        late = staging.stage(late, "late")
        known = late.select("id", F.col("conv_id").alias("found"))
        # ranges and the nodes open in them, so that many children of one node are not one key
        there = there.unionByName(opened.select("part", "id").join(known, "id").select("part", F.col("id").alias("parent"), "found"))
        above = late.drop("parent_conv_id").join(known.select(F.col("id").alias("parent"), F.col("found").alias("parent_conv_id")), "parent", "left")
        whole = whole.unionByName(above.select(columns))
    waiting = within.filter("parent is not null").join(there, ["part", "parent"]).withColumn("parent_conv_id", F.col("found"))
    within = whole.unionByName(waiting.select(columns))
    return within.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _shared(a: Column, b: Column) -> Column:
    """Turns that two arrays share from the start; -1 where there is none beside it."""

    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else common(bytes(x), bytes(y)) for x, y in zip(left, right)], dtype="int32")

    return F.pandas_udf(of, "int")(a, b)


def report(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return trie(rebuilt(turns))
