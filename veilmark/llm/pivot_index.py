"""Near-duplicates of embeddings through a pivot-permutation index.

Method.  A bounded sample of the vectors, without those too close to another of it, serves as reference points: a
dense cluster holds few pivots however many vectors it has, so its members order the same ones first.  Every vector is
described by its ``nearest`` pivots (more of them, the more pivots there are) in the order of their distance, and entered in the inverted list of each.  Shared
pivots are counted from the lists: two vectors are candidates if they share ``min_shared`` of them, or put the same
one first.  Only candidates are verified, by their cosine in double precision, and every pair found is a link.  A pair
is looked at in the list of its smallest shared pivot only.

Scale.  Equal vectors are one entry with a multiplicity.  Lists are cut in blocks by a hash, and each task counts and
compares two blocks of one list; what it returns is a count and a component label for each of its vectors, never the
pairs.  The number of pivots drawn grows as the square root of the number of vectors while they fit ``PIVOT_BYTES``,
which bounds what is broadcast.  A block follows the mean list, so that an entry is copied a few times, but never holds
more than ``BLOCK_BYTES`` whatever the table; a hot list becomes more tasks, not larger ones, and the work in it grows
with the square of its length, as the links of a dense cluster do.

Recall is what the index trades: against brute force on the test tables, and with a third of the vectors in one dense
cluster, it is 0.99 and more with the defaults.  Of pairs at a cosine of 0.903 in 64 dimensions, drawn evenly, 0.99 and more
become candidates with 64 to 131 072 pivots.

Defined cases.  Vectors that are null, zero, empty, or hold null or non-finite components link with nothing; they are
their own component and are kept.  Vectors of different lengths link with none of another length.  Rows of equal
vectors link with each other.  Rows that share an id, or have none, count as different vectors.  An empty table gives
an empty result.  Extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm import repeats, staging
from veilmark.llm.components import components, labels

COSINE = 0.9
#: At least so many pivots describe a vector; see ``lists``.
NEAREST = 8
MIN_SHARED = 2
#: Bounds: what is broadcast, a block of a list, and a table of distances or counts in a task.
PIVOT_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
TABLE_BYTES = 16 << 20
LEAST_BLOCK = 128
CHUNK = 1024


def _bytes(own: DataFrame) -> DataFrame:
    """uid, vector (little-endian doubles) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, out = [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not vector.is_valid or not len(vector.values) or vector.values.null_count:
                    continue
                v = vector.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(v).all() and v.any():
                    uid.append(key)
                    out.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(out, pa.binary())], ["uid", "vector"])

    return own.select("uid", "text").mapInArrow(run, "uid long, vector binary")


def _unit(vectors: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def apart(pivots: list[bytes], cosine: float) -> list[bytes]:
    """The pivots, in their order, that are farther from each one before them than sqrt(2) times the distance of a link."""
    limit, kept = 2 * cosine - 1, []
    for length in sorted(set(map(len, pivots))):
        own = [p for p in pivots if len(p) == length]
        unit = _unit(own)
        chosen: list[int] = []
        for start in range(0, len(own), 256):
            some = unit[start : start + 256]
            free = (some @ unit[chosen].T).max(axis=1, initial=-2) < limit
            near, new = some @ some.T >= limit, []
            for i in np.flatnonzero(free).tolist():
                if not near[i, new].any():
                    new.append(i)
            chosen += [start + i for i in new]
        kept += [own[i] for i in chosen]
    return kept


def lists(pivots: int) -> int:
    """How many pivots describe a vector: among more pivots, near vectors share fewer of as many."""
    return max(NEAREST, (max(1, pivots) - 1).bit_length() - 1)


def described(unit: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """For each vector the places of its nearest pivots, by distance, ties by place."""
    rows = []
    step = max(1, TABLE_BYTES // (8 * len(pivots)))
    for at in range(0, len(unit), step):
        far = -(unit[at : at + step] @ pivots.T)
        if len(pivots) > 4 * nearest:
            # all that may be among the nearest, ties included
            edge = np.partition(far, nearest - 1, axis=1)[:, nearest - 1 : nearest]
            for own, last in zip(far, edge):
                some = np.flatnonzero(own <= last)
                rows.append(some[np.argsort(own[some], kind="stable")[:nearest]])
        else:
            rows += list(np.argsort(far, axis=1, kind="stable")[:, :nearest])
    return np.array(rows, np.int64).reshape(len(unit), -1)


def index(classes: DataFrame, pivots: list[bytes], nearest: int) -> DataFrame:
    """list, node, times, signature (the pivots by distance), vector: an entry in each of a vector's lists."""
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        by_length.setdefault(len(p), []).append(i)
    by_length = {n: own if len(own) > nearest else own[:1] for n, own in by_length.items()}  # else all lists would be the same
    shared = classes.sparkSession.sparkContext.broadcast({n: (np.array(own), _unit([pivots[i] for i in own])) for n, own in by_length.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                vectors = batch.column(2).to_pylist()
                for length in sorted(set(map(len, vectors))):
                    rows = [i for i, v in enumerate(vectors) if len(v) == length]
                    if length in points:
                        ids, unit = points[length]
                        found = ids[described(_unit([vectors[i] for i in rows]), unit, nearest)]
                    else:  # no pivot of this length was drawn: one list for all of them
                        found = np.full((len(rows), 1), -length, np.int64)
                    sign = [f.astype("<i4").tobytes() for f in found]
                    m = found.shape[1]
                    at = np.repeat(rows, m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel(), pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([s for s in sign for _ in range(m)], pa.binary()), batch.column(2).take(pa.array(at))],
                        ["list", "node", "times", "signature", "vector"],
                    )

    return classes.select("node", "times", "vector").mapInArrow(run, "list int, node long, times long, signature binary, vector binary")


def shared_counts(left: np.ndarray, right: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many pivots each two signatures share, whether one of them is smaller than ``here``), from inverted lists."""
    count = np.zeros((len(left), len(right)), np.uint8)
    owned = np.zeros(count.shape, bool)
    lists = [(p.ravel()[order := np.argsort(p, axis=None, kind="stable")], order // p.shape[1]) for p in (left, right)]
    (a, a_rows), (b, b_rows) = lists
    for pivot in np.intersect1d(a, b):
        some = a_rows[np.searchsorted(a, pivot) : np.searchsorted(a, pivot, "right")]
        others = b_rows[np.searchsorted(b, pivot) : np.searchsorted(b, pivot, "right")]
        count[some[:, None], others] += 1
        if pivot < here:
            owned[some[:, None], others] = True
    return count, owned


def _compare(cosine: float, min_shared: int):  # noqa: ANN202
    def run(key: tuple, table: pa.Table) -> pa.Table:
        here, i, j = (k.as_py() for k in key)
        block = table.column("block").to_numpy()
        node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
        unit = _unit(table.column("vector").to_pylist())
        sign = np.stack([np.frombuffer(s, "<i4") for s in table.column("signature").to_pylist()])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        need = min(min_shared, sign.shape[1])
        links, pairs = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64),) * 2]
        step = max(1, min(256, TABLE_BYTES // (8 * max(1, len(right)))))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            count, owned = shared_counts(sign[some], sign[right], here)
            candidate = ((count >= need) | (sign[some, :1] == sign[right, 0])) & ~owned
            if i == j:
                candidate &= some[:, None] < right
            a, b = np.nonzero(candidate)
            if len(a) * 16 > candidate.size:  # so many that one product is cheaper than one for each pair
                close = (unit[some] @ unit[right].T)[a, b] >= cosine
            else:
                close = np.concatenate([np.einsum("ij,ij->i", unit[some[a[c : c + 65_536]]], unit[right[b[c : c + 65_536]]]) for c in range(0, len(a), 65_536)] or [np.zeros(0)]) >= cosine
            p, q = some[a[close]], right[b[close]]
            np.add.at(links, p, times[q])
            np.add.at(links, q, times[p])
            pairs.append((p, q))
            if sum(len(x) for x, _ in pairs) > 1 << 20:  # a forest connects the same
                pairs = [_tree(len(node), pairs)]
        a, b = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(node, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        label = node[order][labels(len(node), rank[a], rank[b])][rank] if len(a) else node
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "label": label[some]})

    return run


def _tree(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*pairs))
    label = labels(n, a, b)
    return np.arange(n), label


def block_rows(mean: float, vector_bytes: int) -> int:
    """Entries to a block of a list: a part of the mean list, within BLOCK_BYTES."""
    return int(max(1, min(max(LEAST_BLOCK, mean * 0.4), BLOCK_BYTES // (vector_bytes + 64))))


def neighbours(classes: DataFrame, n_classes: int, cosine: float = COSINE, nearest: int | None = None, min_shared: int = MIN_SHARED, n_pivots: int | None = None) -> DataFrame:
    """node, links, label of the tasks: how many vectors a node links with, and a node it is connected with."""
    spark = classes.sparkSession
    width = classes.agg(F.max(F.octet_length("vector"))).first()[0]
    wanted = n_pivots or max(16, 1 << round(np.log2(1.2 * np.sqrt(max(1, n_classes)))))
    drawn = max(1, min(wanted, PIVOT_BYTES // width))
    pivots = [bytes(r.vector) for r in classes.orderBy(F.xxhash64("node"), "node").limit(drawn).select("vector").collect()]
    drawn, pivots = len(pivots), apart(pivots, cosine)
    nearest = nearest or lists(len(pivots))
    mean = n_classes * nearest / max(1, drawn)  # as drawn: blocks must not grow when few pivots are left
    entries = staging.stage(index(classes, pivots, nearest), "entries")
    sizes = entries.groupBy("list").count()
    blocks = F.broadcast(sizes.select("list", F.ceil(F.col("count") / block_rows(mean, width)).cast("int").alias("n")))  # a row for each pivot
    dealt = entries.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "times", "signature", "vector")
    dealt = dealt.repartition(staging.tasks(spark), "list", "i", "j")
    return dealt.groupBy("list", "i", "j").applyInArrow(_compare(cosine, min_shared), "node long, links long, label long")


def link(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", **how: object) -> DataFrame:
    """A row per row of vectors: vec_id, n_links, component_id, kept."""
    own = repeats.identified(vectors, vector, id_col)
    valid = staging.stage(_bytes(own), "valid")
    classes = staging.stage(valid.groupBy("vector").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("times")), "classes")
    n_classes = classes.count()
    ids = own.select("uid", "doc_id")
    if not n_classes:
        return ids.select(F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staging.stage(neighbours(classes, n_classes, **how), "found")
    linked = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = classes.join(counts, "node", "left").join(linked, "node", "left")
    facts = facts.select("vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    member = valid.join(facts, "vector").select("uid", "n_links", "component")
    rows = ids.join(member, "uid", "left").select("uid", "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    names = ids.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.join(names, "component").select(F.col("doc_id").alias("vec_id"), "n_links", "component_id", (F.col("uid") == F.col("component")).alias("kept"))


def report(vectors: DataFrame) -> DataFrame:
    return link(vectors)
