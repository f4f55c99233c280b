"""Mixing sources to target weights by Sainte-Lague apportionment.

Method.  Words are dealt in blocks of equal size.  Targets per source are water-filled from the weights and stop at
``max_epochs`` times the source; blocks go to sources by highest quotients target / (2k - 1), then, within a source,
to bins of shards and in these to shards of its documents in the same way by size.  What a bin or shard can't hold goes
to those of its group that have room.  Each shard puts its documents in a seeded order, and its quota takes the blocks
of that stream in order, starting again at its head once all words are taken; so whole documents are taken but for the
last block's, and none is taken more than ``max_epochs`` times.

Scale.  Texts are read once, to count words.  What is shuffled are (source, id, size) records.  Sources may be many:
they are ranked by a range-partitioned sort, and their level is found by sums, so no task holds them all.  A source of
a third of all rows is cut in shards, and its shards in bins; no step orders more than a shard's documents, a bin's
shards or a source's bins.  The only seats that quotients decide one by one are those left after every party's
guaranteed seats: at most three times the number of parties.

Defined cases.  A null text has size 0, and so has one without words; they take nothing.  A null source is a source of
its own, ordered last.  A null id names nothing: its rows count as any others.  Repeated rows count each.  A very long text is
counted, and cut, as one value.  An empty table gives an empty result.  Extra columns, whatever their
names, are carried by ``sample`` and do not matter elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import repeats, staging

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 64
SHARD_ROWS = 512
BIN_SHARDS = 512


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their numbers from 1 in that order, which no single task sorts: the number in a range, and the ranges' offsets."""
    ordered = staging.stage(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumns({"__range": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)})
    ranges = ordered.groupBy("__range").agg((F.max("__at") + 1).alias("__n"))  # a row for each partition of the sort
    before = ranges.select(F.col("__range"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return ordered.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__before") + F.col("__at") + 1).alias(name))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sources (source, source_size) with place (by code point, null last), weight and target.

    The excess of capped sources is reshared by weight until none is above its cap: the level, words for a unit of
    weight, rises with each source found capped, and stands once none is added.
    """
    table = numbered(sources, [F.col("source").isNull(), F.col("source").cast("binary")], "place")
    table = table.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")), "cap": F.col("source_size") * F.lit(max_epochs)})
    table = staging.stage(table, "weighted")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, count = 0.0, -1
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        full, weight, now = table.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if now == count:
            break
        count = now
        level = (total - (full or 0.0)) / weight if weight else float("inf")
    return table.select("source", "source_size", "place", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def apportion_all(parties: DataFrame, key: str, votes: str, seats: int) -> DataFrame:
    """``apportion`` for one group of any number of parties; equal quotients go by key."""
    total, n = parties.agg(F.sum(F.col(votes).cast("double")), F.count(F.lit(1))).first()
    share = F.col(votes).cast("double") / F.lit(total or 1.0)
    bounds = {"__sure": F.greatest(F.lit(0), F.ceil(share * (seats - n / 2) - 0.5) - 1), "__most": F.floor(share * (seats + n / 2) + 0.5) + 1}
    table = parties.withColumns(bounds)
    left = seats - (table.agg(F.sum("__sure")).first()[0] or 0)
    ranked = table.filter(F.col(votes) > 0).select(F.col(key).alias("__key"), F.col(votes).cast("double").alias("__v"), F.explode(F.sequence(F.col("__sure") + 1, F.col("__most"))).alias("__seat"))
    won = numbered(ranked, [(F.col("__v") / (2 * F.col("__seat") - 1)).desc(), F.col("__key"), F.col("__seat")], "__rank").filter(F.col("__rank") <= left).groupBy("__key").agg(F.count(F.lit(1)).alias("__won"))
    joined = table.join(won, table[key] == won["__key"], "left")
    return joined.select(*(parties[c] for c in parties.columns), (F.col("__sure") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota"))


def apportion(parties: DataFrame, within: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """parties with an integer ``quota``: ``seats`` (the same in all rows of a group) dealt by Sainte-Lague.

    With V votes, S parties and B seats, the divisor V / (B + S/2) gives out B seats at least and V / (B - S/2) at
    most B.  The second fixes seats that a party has in any case; only those between the two are ranked by quotient.
    Equal quotients go by ``order``.
    """
    group = Window.partitionBy(*within)
    v, b = F.col(votes).cast("double"), F.col(seats)
    share = F.when(F.col("__votes") > 0, v / F.col("__votes")).otherwise(F.lit(0.0))
    table = parties.withColumns({"__votes": F.sum(F.col(votes).cast("double")).over(group), "__n": F.count(F.lit(1)).over(group)})
    table = table.withColumns({"__sure": F.greatest(F.lit(0), F.ceil(share * (b - F.col("__n") / 2) - 0.5) - 1), "__most": F.floor(share * (b + F.col("__n") / 2) + 0.5) + 1})
    table = table.withColumn("__left", b - F.sum("__sure").over(group))
    key = [*within, "__order"]
    table = table.withColumn("__order", F.row_number().over(group.orderBy(*order)))
    ranked = table.filter((v > 0) & (F.col("__left") > 0)).select(*key, "__left", v.alias("__v"), F.explode(F.sequence(F.col("__sure") + 1, F.col("__most"))).alias("__seat"))
    best = group.orderBy((F.col("__v") / (2 * F.col("__seat") - 1)).desc(), "__order")
    won = ranked.withColumn("__rank", F.row_number().over(best)).filter("__rank <= __left").groupBy(*key).agg(F.count(F.lit(1)).alias("__won"))
    same = F.lit(True)
    won = won.select(*(F.col(c).alias(f"__w_{c}") for c in key), "__won")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    joined = table.join(won, same, "left")
    return joined.select(*(parties[c] for c in parties.columns), (F.col("__sure") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota"))


def dealt(parties: DataFrame, within: list[str], size: str, order: Column, block_words: int, max_epochs: float) -> DataFrame:
    """parties with ``words``: the group's ``given`` words, dealt in blocks by size; what is over goes to who has room."""
    seats = parties.withColumn("__seats", F.floor(F.col("given") / block_words))
    quota = apportion(seats, within, size, "__seats", [order]).withColumn("__cap", F.floor(F.col(size) * F.lit(max_epochs)))
    group = Window.partitionBy(*within)
    quota = quota.withColumn("__words", F.least(F.col("quota") * block_words, F.col("__cap")))
    quota = quota.withColumns({"__over": F.col("given") - F.sum("__words").over(group), "__room": F.col("__cap") - F.col("__words")})
    before = F.coalesce(F.sum("__room").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__over") - before))
    return quota.select(*(c for c in parties.columns if c != "given"), (F.col("__words") + more).cast("long").alias("words"))


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: int = 17) -> DataFrame:
    """A row per row of docs: doc_id, size, source_size, target, taken; taken is passes times the size and part of one more."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[source].cast("string").alias("source"), F.xxhash64(docs[text]).alias("row_key"), F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staging.stage(own, "sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = targets(by_source.drop("n_rows"), weights, budget, max_epochs)
    sources = staging.stage(sources.join(by_source.drop("source_size").withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "weight"), "sources")
    seats = round((sources.agg(F.sum("target")).first()[0] or 0) / block_words)
    every = apportion_all(sources, "place", "target", seats)
    every = every.withColumn("given", F.least(F.col("quota") * block_words, F.floor(F.col("source_size") * F.lit(max_epochs)))).withColumn("n_shards", F.ceil(F.col("n_rows") / shard_rows))
    every = staging.stage(every.select("source", "source_size", "place", "target", "given", "n_shards", F.ceil(F.col("n_shards") / BIN_SHARDS).alias("n_bins")), "dealt")
    few = F.broadcast(every) if every.count() <= 50_000 else every
    rows = sizes.join(few, sizes["source"].eqNullSafe(every["source"])).drop("source")
    rows = rows.withColumn("at", F.xxhash64("doc_id", "row_key", F.lit(seed))).withColumn("shard", F.pmod("at", F.col("n_shards"))).withColumn("bin", F.pmod("shard", F.col("n_bins")))
    shards = staging.stage(rows.groupBy("place", "bin", "shard").agg(F.sum("size").alias("shard_size"), F.first("given").alias("given")), "shards")
    bins = shards.groupBy("place", "bin").agg(F.sum("shard_size").alias("bin_size"), F.first("given").alias("given"))
    bins = dealt(bins, ["place"], "bin_size", F.col("bin"), block_words, max_epochs).select("place", "bin", F.col("words").alias("given"))
    shards = shards.drop("given").join(bins, ["place", "bin"])
    shards = staging.stage(dealt(shards, ["place", "bin"], "shard_size", F.col("shard"), block_words, max_epochs).drop("bin"), "quotas")
    stream = Window.partitionBy("place", "shard").orderBy(F.xxhash64("at"), "at", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(shards, ["place", "shard"])
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.col("words") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return rows.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), passes.cast("long").alias("passes"), part.cast("long").alias("part"))


def sample(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how: object) -> DataFrame:
    """The mixture itself: each document as often as it is wholly taken, and once more with just its taken words.

    All columns are carried; a row with part of a text holds its first taken words, up to the end of the last.  Rows
    that share an id, or have none, are numbered in a staged copy, so that each has its own share.
    """
    number, key, times, part, whole, copy = staging.free(docs.columns, "__uid", "__id", "__passes", "__part", "__whole", "__copy")
    own, uid = (docs, id_col) if repeats.own_ids(docs, id_col) else (repeats.numbered(docs, text, id_col, number), number)
    plan = mix(own, text, uid, **how).filter("passes > 0 or part > 0")
    plan = staging.stage(plan.select(F.col("doc_id").alias(key), F.col("passes").alias(times), F.col("part").alias(part), (F.col("part") == F.col("size")).alias(whole)), "plan")
    rows = own.join(plan.hint("shuffle_hash"), own[uid] == plan[key])
    copies = F.col(times) + F.when(F.col(part) > 0, 1).otherwise(0)
    rows = rows.select(*(own[c] for c in docs.columns), times, part, whole, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy))
    words = F.regexp_extract_all(F.col(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col(part).cast("int")), "")
    return rows.withColumn(text, F.when((F.col(copy) <= F.col(times)) | F.col(whole), F.col(text)).otherwise(cut)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
