"""Corpus summaries of observed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.sources.reading import suffix

HYPOTHESES = tuple(f"h{i}" for i in range(1, 8))


def flagged(observed: Column) -> Column:
    return (observed["h1"] == 1) & (sum((observed[h] for h in HYPOTHESES[2:]), observed["h2"]) > 0)


def totals(observed: DataFrame, o: str = "o") -> DataFrame:
    """total, parsed, unparsed, clean, flagged: one pass."""
    parsed, flag = F.col(f"{o}.h1") == 1, flagged(F.col(o))
    return observed.agg(F.count(F.lit(1)).alias("total"), F.count_if(parsed).alias("parsed"), F.count_if(~parsed).alias("unparsed"), F.count_if(parsed & ~flag).alias("clean"), F.count_if(flag).alias("flagged"))


def mask_counts(observed: DataFrame, o: str = "o") -> DataFrame:
    return observed.groupBy(F.col(f"{o}.mask").alias("mask")).agg(F.count(F.lit(1)).alias("documents"))


def hypothesis_counts(observed: DataFrame, o: str = "o") -> DataFrame:
    """hypothesis, documents: all seven, over parsed documents."""
    sums = observed.agg(*(F.coalesce(F.sum(F.when(F.col(f"{o}.h1") == 1, F.col(f"{o}.{h}"))), F.lit(0)).cast("long").alias(h.upper()) for h in HYPOTHESES))
    return sums.unpivot([], [h.upper() for h in HYPOTHESES], "hypothesis", "documents")


def extension(path: Column) -> Column:
    """The file name's last suffix in lower case; <none> if it has none, as dotfiles don't."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(F.lower(suffix(name)), F.lit("")), F.lit("<none>"))


def extension_counts(sources: DataFrame, path: str = "source") -> DataFrame:
    return sources.groupBy(extension(F.col(path)).alias("extension")).agg(F.count(F.lit(1)).alias("documents"))


def row_class(observed: Column) -> Column:
    return F.when(observed["h1"] == 0, "unparsed").when(flagged(observed), "flagged").otherwise("clean")


def mask_colour(mask: Column) -> Column:
    return F.when(mask.startswith("0"), "grey").when(mask == "1000-000", "green").otherwise("red")


def evidence_line(evidence: Column, most: int = 2, longest: int = 120) -> Column:
    """The first thing said for each of H2 to H7, the first ``most`` of these, cut to ``longest`` characters."""
    first = F.array(*(F.when(F.get(evidence[h], F.lit(0)) != "none", F.concat(F.lit(f"[{h.upper()}] "), F.get(evidence[h], F.lit(0)))) for h in HYPOTHESES[1:]))
    line = F.array_join(F.slice(F.filter(first, lambda x: x.isNotNull()), 1, most), " / ")
    return F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest - 3), F.lit("..."))).otherwise(line)
