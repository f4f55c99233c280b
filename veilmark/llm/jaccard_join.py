"""Similarity join of documents on the Jaccard index of their word n-grams, by token-combination prefixes.

Method.  A document is the set of its distinct word shingles ("tokens"), put in one global order: rare tokens first,
then frequent ones, by hash within each class.  Two sets of the needed similarity differ in few tokens, so their
prefixes in that order share some; how many is known from the set's size alone.  Rare tokens are indexed singly.  For
frequent ones single matches say little, so where a prefix reaches into that class it is extended, and combinations
of two frequent tokens are indexed: with e errors allowed and r rare tokens in the prefix, e + 2 - r frequent tokens
always leave one shared pair.  (Sets over ``COMBINE_SIZE`` tokens index frequent tokens singly as well, and sets near
that size do both, so that any two similar sets use one common form.)  Candidates meet in their signature's group and
are verified on the whole texts, word by word: hashes only find what is compared.

Scale.  Documents with equal sets are one class, found before anything is compared.  Which tokens are frequent is
decided from all documents (a token in more than ``FREQUENT_SHARE`` of them, so the table has at most mean size /
share entries); it only orders tokens, so a different choice can't change the result.  Signatures are shuffled once;
what no other class of a possible size has, most of them, goes no further, and groups with the same members are one.
Large groups that overlap much are united (``_united``): near copies share many signatures, and are compared once.

No pairs are made between tables.  A group's memberships carry a parity bitmap of the class's tokens; two bitmaps
differ in no more bits than the sets in tokens, so a task drops at once, and loses none, what differs in too many.
Groups of more than ``BLOCK`` classes are dealt in blocks by size and hash, never ordered.  Rounds, each of which
verifies what it proposes on the texts and labels what it has connected: first each class meets the others that chose
the same groups, its largest and its smallest, and the group's first class, and a spanning forest of what seems similar
is proposed; then the same among one class of each label of large groups; at last, in the groups that still hold several
labels and in block pairs of possible sizes, every pair of different labels that larger bitmaps, made only of classes
that the small ones leave in doubt, can't tell apart either.

Defined cases.  Null texts and texts without words have no shingles and link with nothing.  Rows that share a doc_id,
or have none, count as documents of their own, ordered by text.  Copies share a class.  An empty table gives an empty
result.  Extra columns, whatever their names, do not matter.  Very long texts: a task holds the shingles of one hub and
one partner at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import repeats, staging
from veilmark.llm.components import components
from veilmark.llm.sequences import Numbers, Rolling, Words, handed_back, mixed, runs, shingles

#: Production parameters: words to a shingle, and the least similarity in hundredths.
WIDTH = 5
PERCENT = 80
FREQUENT_SHARE = 0.0005
COMBINE_SIZE = 400
#: A block of a group: about so many classes, and so many tokens.
BLOCK = 512
BLOCK_TOKENS = 400_000
FLUSH_TOKENS = 500_000
#: A signature that so many classes of an Arrow batch have goes round the window that looks for partners.
CROWD = 64
#: Groups of so many classes are put together where they overlap much.
UNITE = 64
#: Up to so many ids (8 bytes each) are broadcast to drop the texts that no task wants before they are shuffled.
BROADCAST_IDS = 1_000_000
#: Memberships that a task compares at a time, and bytes of bitmaps in one comparison.
CHUNK_ROWS = 10_000
COMPARE_BYTES = 4 << 20
NUMBERS_BYTES = 8 << 20
#: How many times larger the bitmaps of the last round are.
SHARP = 8
#: Rows of an Arrow batch of texts: several batches are in memory at a time, on both sides.
BATCH_ROWS = 2_000


def _errors(size: int, percent: int) -> int:
    """How many tokens of a set of ``size`` a set of that similarity can lack at most."""
    return size - -(-percent * size // 100)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(batch, first row, for each row its sorted distinct shingle hashes and the second hash of each)."""
    for batch in batches:
        for at, data, offsets in runs(batch.column(1)):
            words = Words(data, offsets, lower=True)
            first, edges = shingles(words, words.hash, width)
            second, _ = shingles(words, words.other, width)
            sets = []
            for low, high in zip(edges[:-1], edges[1:]):
                tokens, where = np.unique(first[low:high], return_index=True)
                sets.append((tokens, second[low + where]))
            yield batch, at, sets


def class_of(tokens: np.ndarray, others: np.ndarray) -> bytes | None:
    """Sixteen bytes, a digest of both hashes of all tokens, that equal sets have; None for the empty set."""
    return hashlib.blake2b(np.concatenate([tokens, others]).tobytes(), digest_size=16).digest() if len(tokens) else None


def bitmap(tokens: np.ndarray, factor: int = 1) -> bytes:
    """For each of 2 to 4 times as many bits as there are tokens (times ``factor``), the parity of the tokens that fall on it."""
    bits = factor << max(6, (2 * len(tokens) - 1).bit_length())
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def profile(docs: DataFrame, width: int) -> DataFrame:
    """uid, size, class (c1, c2) and bits of each document; and, with uid null, tokens frequent in a task: token, rows.

    A token that a share s of all documents has is in that share of some task's documents.  Counts are lossy: tokens
    rare so far are dropped whenever ``FLUSH_TOKENS`` are held, so one near the share may be missed, and is then
    ordered with the rare ones, everywhere alike.
    """

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, seen, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, [], 0
        schema = pa.schema([("uid", pa.int64()), ("size", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bits", pa.binary()), ("token", pa.int64()), ("rows", pa.int64())])

        def fold() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([tokens, *held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(counts), np.int64)]), len(every)).astype(np.int64)
            held.clear()
            keep = n >= max(2, FREQUENT_SHARE / 2 * seen)  # what is rare so far in this task may be dropped: it only orders
            return every[keep], n[keep]

        for batch, at, sets in _sets(batches, width):
            names = [np.frombuffer(name, "<i8").tolist() if (name := class_of(*s)) else (None, None) for s in sets]
            n = len(sets)
            c1, c2 = (pa.array(c, pa.int64()) for c in zip(*names))
            bits = pa.array([bitmap(s) if len(s) else None for s, _ in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).cast(pa.int64()), pa.array([len(s) for s, _ in sets], pa.int64()), c1, c2, bits, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
            seen += n
            held += [s for s, _ in sets]
            size += sum(len(s) for s, _ in sets)
            if size >= FLUSH_TOKENS:
                (tokens, counts), size = fold(), 0
        if seen:
            tokens, counts = fold()
            some = counts >= max(2, FREQUENT_SHARE * seen)
            tokens, counts = tokens[some], counts[some]
            n = len(tokens)
            none = [pa.nulls(n, f.type) for f in schema][:5]
            yield pa.RecordBatch.from_arrays([*none, pa.array(tokens.view(np.int64)), pa.array(counts)], schema=schema)

    return docs.select("uid", "text").mapInArrow(run, "uid long, size long, c1 long, c2 long, bits binary, token long, rows long")


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The signature hashes of one sorted set; ``frequent`` is sorted."""
    n = len(tokens)
    errors = _errors(n, percent)
    at = np.searchsorted(frequent, tokens)
    often = np.zeros(n, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == tokens
    rare, many = tokens[~often], tokens[often]
    single = [rare[: errors + 1]]
    r = len(single[0])
    if r <= errors and len(many):
        if n * 100 >= COMBINE_SIZE * percent:
            single.append(many[: errors + 1 - r])
        if n <= COMBINE_SIZE:
            need = many[: errors + 2 - r]
            pairs = np.array(list(combinations(range(len(need)), 2)), np.int64).reshape(-1, 2)
            with np.errstate(over="ignore"):
                single.append(mixed(need[pairs[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + need[pairs[:, 1]]))
            if len(many) < errors + 2 - r:  # the whole set is used up: the last error can take a pair's partner
                single.append(mixed(many ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(single)


def _crowded(sign: np.ndarray, size: np.ndarray, percent: int, crowd: int) -> np.ndarray:
    """For each membership 0, or, of a signature with ``crowd`` of them, 1 for a delegate and 2 for the others.

    Delegates are the least and the largest of each band of sizes within the needed ratio.
    """
    state = np.zeros(len(sign), np.int8)
    every, at, n = np.unique(sign, return_inverse=True, return_counts=True)
    many = np.flatnonzero(n[at] >= crowd)
    if len(many):
        band = np.floor(np.log(size[many]) / np.log(100 / min(percent, 99))).astype(np.int64)
        order = np.lexsort((size[many], band, at[many]))
        rows, band, group = many[order], band[order], at[many][order]
        first = np.r_[True, (band[1:] != band[:-1]) | (group[1:] != group[:-1])]
        state[rows] = 2
        state[rows[first | np.r_[first[1:], True]]] = 1
    return state


def index(docs: DataFrame, frequent: np.ndarray, width: int, percent: int, crowd: int = CROWD) -> DataFrame:
    """signature, c1, c2 (the class), size, state (see ``_crowded``); of equal sets a task gives one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        own = shared.value
        for _, _, sets in _sets(batches, width):
            sign, facts = [np.zeros(0, np.uint64)], []
            for s, others in sets:
                name = class_of(s, others)
                if name is None or name in given:
                    continue
                if len(given) >= 1_000_000:
                    given.clear()
                given.add(name)
                sign.append(signatures(s, own, percent))
                facts.append((len(sign[-1]), *np.frombuffer(name, "<i8"), len(s)))
            n, c1, c2, size = np.array(facts, np.int64).reshape(-1, 4).T
            every, (c1, c2, size) = np.concatenate(sign), (np.repeat(x, n) for x in (c1, c2, size))
            yield pa.RecordBatch.from_arrays([every.view(np.int64), c1, c2, size, pa.array(_crowded(every, size, percent, crowd))], ["signature", "c1", "c2", "size", "state"])

    return docs.select("uid", "text").mapInArrow(run, "signature long, c1 long, c2 long, size long, state byte")


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (signature, node, ...) of one signature for all that have the same members; with n, the members."""
    facts = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).filter("n > 1")
    one = facts.groupBy("n", "h1", "h2").agg(F.min("signature").alias("signature"))
    return rows.join(one.select("signature", "n"), "signature")


def _united(rows: DataFrame, least: int) -> DataFrame:
    """rows with groups of ``least`` classes or more, where they overlap much, put together; pairs in a group stay in one.

    A group follows the largest group of its first class.  The followers of one become their union if that has fewer
    pairs than they have together, so each pair of classes that share many signatures is compared once.
    """
    large = rows.filter(F.col("n") >= least)
    first = large.groupBy("signature").agg(F.min("node").alias("node"), F.max("n").alias("n"))
    leader = large.groupBy("node").agg(F.max(F.struct("n", "signature")).getField("signature").alias("leader"))
    led = staging.stage(first.join(leader, "node").select("signature", "n", "leader"), "led")
    if not led.limit(1).count():
        return rows
    union = staging.stage(large.join(led.select("signature", "leader"), "signature").groupBy("leader", "node").agg(F.min("size").alias("size")), "union")
    before = led.groupBy("leader").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("before"), F.count(F.lit(1)).alias("groups"))
    after = union.groupBy("leader").agg(F.count(F.lit(1)).cast("double").alias("members"))
    good = staging.stage(before.join(after, "leader").filter("groups > 1 and members * members < before").select("leader"), "united")
    gone = led.join(good, "leader", "left_semi").select("signature")
    made = union.join(good, "leader", "left_semi").select(F.col("leader").alias("signature"), "node", "size")
    return rows.join(gone, "signature", "left_anti").select("signature", "node", "size").unionByName(made)


def candidates(signed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """signature, node, size, n: groups of classes that may be similar, from ``index``'s rows.

    Dropped are classes that share a signature with none of a possible size.  Of crowded signatures only delegates meet
    the others in the window; as one stands for sizes within the needed ratio, there what is kept is what has a partner
    within its square.  The rest of a crowd is spread by class.
    """
    signed = signed.withColumn("salt", F.when(F.col("state") == 2, F.pmod("c1", F.lit(1 << 10)) + 1).otherwise(F.lit(0)).cast("short"))
    own = Window.partitionBy("signature", "salt")
    by = own.orderBy("size", "c1", "c2", F.col("state").desc())
    first = ~(F.col("c1").eqNullSafe(F.lag("c1").over(by)) & F.col("c2").eqNullSafe(F.lag("c2").over(by)))
    exact, wide = percent / 100 - 1e-9, percent * percent / 10_000 - 1e-9
    ratio = F.when(F.max("state").over(own) > 0, F.lit(wide)).otherwise(F.lit(exact))
    near = (F.col("state") > 0) | (F.lag("size").over(by) >= F.col("size") * ratio) | (F.col("size") >= F.lead("size").over(by) * ratio)
    linked = signed.withColumn("first", first).filter("first").drop("first").withColumn("near", near).filter("near")
    linked = staging.stage(linked.join(classes.select("c1", "c2", "node"), ["c1", "c2"]).select("signature", "node", "size"), "linked")
    rows = staging.stage(_grouped(linked), "rows")
    united = _united(rows, UNITE)
    return rows if united is rows else staging.stage(_grouped(united), "rows")


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def near_pairs(group: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places p < q of one group (rows lie by group) and different labels that may be similar; by how much they differ, of all.

    side: 0 and 1 where only members of different sides are compared, 2 where all are.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    length = np.array([len(b) for b in bits])
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in np.unique(length).tolist():
        own, larger = np.flatnonzero(length == n), np.flatnonzero(length == 2 * n)
        parts = [np.frombuffer(b"".join(bits[i] for i in rows), "<u8").reshape(len(rows), -1) for rows in (own, larger) if len(rows)]
        table = np.concatenate([parts[0], *map(_folded, parts[1:])])
        at = np.full(len(bits), -1, np.int64)
        at[own], at[larger] = np.arange(len(own)), len(own) + np.arange(len(larger))
        levels[n] = (table, at)
    low, step = np.arange(len(group)), 0
    while len(low):
        step += 1
        low = low[low + step < len(group)]
        low = low[group[low] == group[low + step]]
        high = low + step
        small, large = np.minimum(size[low], size[high]), np.maximum(size[low], size[high])
        some = (label[low] != label[high]) & ((side[low] != side[high]) | (side[low] == 2)) & (small * 100 >= large * percent)
        a, b = low[some], high[some]
        level = np.minimum(length[a], length[b])
        for n in np.unique(level).tolist():
            table, at = levels[n]
            mine = np.flatnonzero(level == n)
            for cut in range(0, len(mine), max(1, COMPARE_BYTES // n)):
                part = mine[cut : cut + max(1, COMPARE_BYTES // n)]
                x, y = a[part], b[part]
                differ = np.bitwise_count(table[at[x]] ^ table[at[y]]).sum(axis=1, dtype=np.int64)
                alike = differ * (100 + percent) <= (size[x] + size[y]) * (100 - percent)
                found.append((x[alike], y[alike], differ[alike] / (size[x] + size[y])[alike]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the pairs those that connect something, nearest first: what they don't connect, hardly another would."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.lexsort((b, a, far))
    left, right = [], []
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def proposed(tasks: DataFrame, percent: int, what: str) -> DataFrame:
    """Pairs (a, b) that may be similar in tasks (signature, i, j, block, node, size, label, bits).

    what: ``forest``, those that connect a task's members if all are similar; ``pairs``, all of them; ``nodes``, only
    who is in any pair, as (a, a).
    """
    key = ["signature", "i", "j"]
    dealt = tasks.repartition(staging.tasks(tasks.sparkSession), *key).sortWithinPartitions(*key, "size", "node")
    names = [*key, "block", "node", "size", "label"]

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            signature, i, j, block, node, size, label = (rows.column(c).to_numpy() for c in names)
            new = np.r_[True, (signature[1:] != signature[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            side = np.where(i == j, 2, block == j)
            a, b, far = near_pairs(np.cumsum(new), size, label, side, rows.column("bits").to_pylist(), percent)
            if what == "forest":
                a, b = _forest(len(node), a, b, far)
            elif what == "nodes":
                a = b = np.unique(np.concatenate([a, b]))
            x, y = node[a], node[b]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            end = [rows.column(c)[-1].as_py() for c in key]
            same = np.logical_and.reduce([rows.column(c).to_numpy() == e for c, e in zip(key, end)])
            cut = int(np.argmax(same))  # the last group may go on
            if cut:
                yield found(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return dealt.select(*names, "bits").mapInArrow(run, "a long, b long").distinct()


def _band(percent: int) -> Column:
    """Sizes that can match lie in one band or in neighbouring ones."""
    return F.floor(F.ln(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("int")


def _blocks(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """rows with band and part: groups of more than ``block`` are split by size, and by hash where that isn't enough."""
    small = rows.filter(F.col("n") <= block).withColumns({"band": F.lit(0), "part": F.lit(0), "parts": F.lit(1)})
    large = rows.filter(F.col("n") > block).withColumn("band", _band(percent))
    sizes = large.groupBy("signature", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int").alias("parts"))
    large = large.join(sizes, ["signature", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return small.unionByName(large.select(*small.columns))


#: A block's place in the order of a group's blocks: bands first.
def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.col("band") * (1 << 20) + F.col("part"))


def within_blocks(rows: DataFrame, hubs: DataFrame, percent: int, block: int) -> DataFrame:
    """Tasks of single blocks; the hub of a group (signature, node, size, label) is in each of its blocks."""
    placed = staging.stage(_numbered(_blocks(rows, percent, block)), "placed")
    guests = placed.select("signature", "block").distinct().join(hubs, "signature").select("signature", "block", "node", "size", "label")
    own = placed.select("signature", "block", "node", "size", "label").unionByName(guests)
    return own.select("signature", F.col("block").alias("i"), F.col("block").alias("j"), "block", "node", "size", "label")


def _hubs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signature").agg(F.min(F.struct("node", "size", "label")).alias("hub")).select("signature", "hub.*")


def _chosen(rows: DataFrame) -> DataFrame:
    """Of each class's memberships those in its largest and its smallest group; n counts who chose the group."""
    fact = F.struct("n", "signature", "size", "label")
    two = rows.groupBy("node").agg(F.max(fact).alias("high"), F.min(fact).alias("low"))
    each = two.select("node", F.explode(F.array_distinct(F.array("high", "low"))).alias("at")).select("node", "at.signature", "at.size", "at.label")
    return each.join(each.groupBy("signature").agg(F.count(F.lit(1)).alias("n")), "signature")


def between_blocks(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Tasks of all pairs of blocks of a group whose sizes can match, and of single ones; a group of one block is one."""
    whole = rows.filter(F.col("n") <= block).select("signature", *(F.lit(0).alias(c) for c in ("i", "j", "block")), "node", "size", "label")
    placed = staging.stage(_numbered(_blocks(rows.filter(F.col("n") > block), percent, block)), "placed")
    blocks = placed.select("signature", "band", "part", "block").distinct()
    left, right = blocks.select("signature", "band", F.col("block").alias("i")), blocks.select("signature", F.col("band").alias("other"), F.col("block").alias("j"))
    pairs = left.join(right, "signature").filter((F.col("i") <= F.col("j")) & (F.col("other") - F.col("band") <= 1))
    sides = pairs.select("signature", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return whole.unionByName(placed.join(sides, ["signature", "block"]).select("signature", "i", "j", "block", "node", "size", "label"))


def _stars(pairs: DataFrame, block: int) -> DataFrame:
    """hub, part, partner (null for the hub itself), node: each a with its partners, so many at a time."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / block))).cast("int").alias("part")
    rows = pairs.join(degree, "a").select(F.col("a").alias("hub"), part, F.lit(True).alias("partner"), F.col("b").alias("node"))
    return rows.unionByName(rows.select("hub", "part", F.lit(False).alias("partner"), F.col("hub").alias("node")).distinct())


class ExactSet:
    """The distinct shingles of one text, known by their words' numbers."""

    def __init__(self, text: bytes, width: int, numbers: Numbers) -> None:
        words = text.lower().split()
        own = numbers.numbers(words)
        if 0 < len(own) < width:
            own = np.r_[own, np.full(width - len(own), -1)]
        rows = np.lib.stride_tricks.sliding_window_view(own, width) if len(own) else own.reshape(0, width)
        with np.errstate(over="ignore"):
            values = mixed(own.astype(np.uint64) + np.uint64(1))
            grams = Rolling(values).grams(width) if len(own) else np.zeros(0, np.uint64)
        self.hash, first, at = np.unique(grams, return_index=True, return_inverse=True)
        self.rows = rows[first]
        self.sound = bool((rows == self.rows[at]).all())
        self.every = None if self.sound else set(map(tuple, rows.tolist()))  # two shingles share a hash

    def __len__(self) -> int:
        return len(self.hash) if self.sound else len(self.every)

    def common(self, other: ExactSet) -> int:
        if self.sound and other.sound:
            _, x, y = np.intersect1d(self.hash, other.hash, assume_unique=True, return_indices=True)
            same = (self.rows[x] == other.rows[y]).all(axis=1)
            return int(same.sum())
        mine, theirs = (s.every if s.every is not None else set(map(tuple, s.rows.tolist())) for s in (self, other))
        return len(mine & theirs)


def _verify(width: int, percent: int):  # noqa: ANN202
    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, said, hub, numbers = None, b"", None, Numbers()
        for batch in batches:
            a, b = [], []
            for name, part, partner, node, text in zip(*(batch.column(i).to_pylist() if i < 4 else batch.column(i) for i in range(5))):
                if not partner:
                    key, said, numbers = (name, part), text.as_py().encode(), Numbers()
                    hub = ExactSet(said, width, numbers)
                    continue
                if key != (name, part):
                    raise RuntimeError("a partner came without its hub")
                if numbers.held > NUMBERS_BYTES + len(said):  # partners' words needn't be kept
                    numbers = Numbers()
                    hub = ExactSet(said, width, numbers)
                other = ExactSet(text.as_py().encode(), width, numbers)
                common = hub.common(other)
                if common * 100 >= (len(hub) + len(other) - common) * percent:
                    a.append(name)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar by the texts of docs (uid, text)."""
    lists = staging.stage(_stars(pairs, block).groupBy(F.col("node").alias("uid")).agg(F.collect_list(F.struct("hub", "part", "partner")).alias("at")), "lists")
    each = _wanted(docs, lists.select(F.col("uid").alias("node"))).join(lists.hint("shuffle_hash"), "uid").select(F.explode("at").alias("at"), F.col("uid").alias("node"), "text")
    dealt = each.select("at.*", "node", "text").repartition(staging.tasks(docs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "partner")
    return staging.stage(dealt.mapInArrow(_verify(width, percent), "a long, b long"), "links")


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) with the same components as all similar pairs in the groups of ``candidates``."""
    bits = classes.select("node", "bits")
    rows = rows.withColumn("label", F.col("node"))
    tried = staging.stage(proposed(within_blocks(_chosen(rows), _hubs(rows), percent, block).join(bits, "node"), percent, "forest"), "tried")
    found = verified(docs, tried, width, percent, block)

    def relabelled(rows: DataFrame) -> DataFrame:
        """Those of the groups that hold more than one label now."""
        own = rows.drop("label").join(components(found), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        own = staging.stage(own, "labelled")
        apart = own.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("signature")
        return staging.stage(own.join(apart, "signature"), "apart")

    left = relabelled(rows)
    large = left.filter(F.col("n") > block)
    if large.limit(1).count():
        some = large.groupBy("signature", "label").agg(F.min(F.struct("node", "size")).alias("one")).select("signature", "label", "one.*")
        some = some.join(some.groupBy("signature").agg(F.count(F.lit(1)).alias("n")), "signature")
        again = proposed(within_blocks(some, _hubs(some), percent, block).join(bits, "node"), percent, "forest").join(tried, ["a", "b"], "left_anti")
        again = staging.stage(again, "again")
        found, tried = found.unionByName(verified(docs, again, width, percent, block)), tried.unionByName(again)
        left = relabelled(left)
    # most of what is left is told apart by the small bitmaps, the rest by larger ones, made for its classes alone
    doubtful = staging.stage(proposed(between_blocks(left, percent, block).join(bits, "node"), percent, "nodes").select(F.col("a").alias("node")), "doubtful")
    if not doubtful.limit(1).count():
        return found
    some = staging.stage(left.drop("n").join(doubtful, "node", "left_semi"), "some")
    some = some.join(some.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "signature")
    sharp = staging.stage(_sharp(docs, doubtful, width), "sharp")
    rest = proposed(between_blocks(some, percent, block).join(sharp, "node"), percent, "pairs").join(tried, ["a", "b"], "left_anti")
    return found.unionByName(verified(docs, staging.stage(rest, "rest"), width, percent, block))


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, text of these nodes (node)."""
    small = nodes.count() <= BROADCAST_IDS
    return docs.select("uid", "text").join(F.broadcast(nodes) if small else nodes, F.col("uid") == F.col("node"), "left_semi")


def _sharp(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, bits: larger bitmaps of these nodes."""

    @handed_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)).cast(pa.int64()), pa.array([bitmap(s, SHARP) for s, _ in sets], pa.binary())], ["node", "bits"])

    return _wanted(docs, nodes).mapInArrow(run, "node long, bits binary")


def link(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """A row per row of docs: uid, doc_id, n_shingles, component (uid), component_id."""
    with staging.batches(docs.sparkSession, BATCH_ROWS):
        return _link(docs, text, id_col, width, percent, block, crowd)


def _link(docs: DataFrame, text: str, id_col: str, width: int, percent: int, block: int, crowd: int) -> DataFrame:
    own = repeats.identified(docs, text, id_col)
    profiled = staging.stage(profile(own, width), "profiled")
    rows = profiled.filter("uid is not null").select("uid", "size", "c1", "c2", "bits")
    n_docs = rows.count()
    seen = profiled.filter("uid is null").groupBy("token").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= FREQUENT_SHARE / 2 * n_docs)
    frequent = np.sort(np.array([r.token for r in seen.select("token").collect()], np.int64).view(np.uint64))
    classes = staging.stage(rows.filter("c1 is not null").groupBy("c1", "c2").agg(F.min("uid").alias("node"), F.min("bits").alias("bits")), "classes")
    groups = candidates(index(own, frequent, width, percent, crowd), classes, percent)
    linked = components(links(own, groups, classes, width, percent, block))
    of_class = classes.join(linked, "node", "left").select("c1", "c2", F.coalesce("component", "node").alias("component"))
    members = rows.drop("bits").join(of_class, ["c1", "c2"], "left").select("uid", F.col("size").alias("n_shingles"), F.coalesce("component", "uid").alias("component"))
    ids = own.select("uid", "doc_id")
    names = ids.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id"))
    return members.join(ids, "uid").join(names, "component").select("uid", "doc_id", "n_shingles", "component", "component_id")


def keep(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one of the smallest doc_id; all columns as they were.

    Rows are dropped one by one: others of the same id, or without one, stay as their own texts decide.
    """
    number, gone = staging.free(docs.columns, "__uid", "__dropped")
    rows, uid = (docs, id_col) if repeats.own_ids(docs, id_col) else (repeats.numbered(docs, text, id_col, number), number)
    found = link(rows, text, uid, width, percent)
    dropped = staging.stage(found.filter("uid <> component").select(F.col("uid").alias(gone)), "dropped")
    left = rows.join(dropped.hint("shuffle_hash"), rows[uid] == F.col(gone), "left_anti")
    return left.select(*(rows[c] for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    return link(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")
