"""Secret scans with multipart credential linking.

Method.  Three base detectors find keyword assignments, access identifiers and long hexadecimal runs.  Further
detectors find weak candidates, which alone mean nothing: account names, mixed-case tokens and endpoints.  Candidates
are intervals of code points; an interval join within a scope (one document, at most ``SCOPE_CHARS`` between the
intervals) of identifiers, secrets and endpoints decides which weak ones are reported:

* ``ident``    (a user, login or client name)       with a secret in scope;
* ``opaque``   (20+ characters, mixed case, digit)  with an identifier in scope;
* ``endpoint`` (scheme://host...)                   with an identifier and a secret in scope.

Here ``access`` and ``ident`` are identifiers; ``assign``, ``hex`` and ``opaque`` are secrets.  Complements must not
overlap, and an opaque token that overlaps a span of another kind (a name's value, a path) is no secret of its own.

Scale.  All in built-in expressions.  One scan applies each detector to the documents that a cheap test lets through;
after it only candidates move, never texts.  The join is an equi-join on (document, bucket of ``SCOPE_CHARS``) and so
emits a bounded number of rows for each candidate; it is a left semi join, so a crowded scope yields no pairs.

Defined cases.  A null text counts as empty: no spans, and the digest of the empty string.  Rows that agree in doc_id
and text are computed once and returned as often as they occur.  A null doc_id is kept as such.  An empty table gives
an empty result.  Extra columns, whatever their names, do not matter.  Very long texts are scanned whole, and their
candidates joined by bucket like any others'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import staging

#: Detectors: kind, pattern, the group whose length counts, its least length.  The first three are the base kinds,
#: and spans that start together are listed in this order.
DETECTORS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("ident", r"""(?i)\b(user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    ("opaque", r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9_.:@/?&=%-]+", 0, 8),
)
#: Cheap necessary conditions, in the same order; a text without one is not searched for that kind.
HINTS = (r"[:=]", "AKIA", r"[0-9a-f]{32}", r"[:=]", r"[A-Za-z0-9+/_-]{20}", "://")
BASE = 3
#: What a match of a kind must hold besides.
MUST = {"opaque": ("[A-Z]", "[a-z]", "[0-9]")}
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "ident"), ("assign", "hex", "opaque"), ("endpoint",)
#: What a weak kind needs in scope: one of each of these sets.
NEEDS = {"ident": (SECRETS,), "opaque": (IDENTIFIERS,), "endpoint": (IDENTIFIERS, SECRETS)}
SCOPE_CHARS = 200


def _matches(text: Column, kind: int) -> Column:
    """array<struct<kind, gap, length, ok>> of one detector's leftmost non-overlapping matches, in order.

    ``gap`` is the length of what stands between a match and the one before it.
    """
    name, pattern, group, least = DETECTORS[kind]
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every.alias("all"), counted.alias("counted")),
        lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["gap"]).alias("gap"), F.length(m["all"]).alias("length"), reduce(lambda a, b: a & b, (m["all"].rlike(p) for p in MUST.get(name, ())), F.length(m["counted"]) >= least).alias("ok")),
    )
    rows = F.filter(rows, lambda m: m["length"].isNotNull())
    return F.when(text.rlike(HINTS[kind]) & text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,gap:int,length:int,ok:boolean>>"))


def candidates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, digest, n_rows and each candidate's kind, start and end; a row of null kind for documents without."""
    content = F.coalesce(docs[text], F.lit(""))
    found = docs.select(docs[id_col].alias("doc_id"), F.sha2(content, 256).alias("digest"), F.concat(*(_matches(content, k) for k in range(len(DETECTORS)))).alias("found"))
    found = found.groupBy("doc_id", "digest").agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("n_rows"))
    each = found.select("doc_id", "digest", "n_rows", F.posexplode_outer("found").alias("at", "match"))
    each = each.select("doc_id", "digest", "n_rows", "at", "match.*")
    ends = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("doc_id", "digest", "kind").orderBy("at"))
    return each.withColumn("end", ends).withColumn("start", F.col("end") - F.col("length"))


def alone(passed: DataFrame) -> DataFrame:
    """passed without opaque tokens that overlap a span of another kind, which says what they are."""
    opaque = [d[0] for d in DETECTORS].index("opaque")
    place = Window.partitionBy("doc_id", "digest").orderBy("start")
    other = lambda c: F.when(F.col("kind") != opaque, F.col(c))
    reach = F.max(other("end")).over(place.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(other("start")).over(place.rangeBetween(1, Window.unboundedFollowing))
    overlaps = (F.col("kind") == opaque) & (F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False)))
    return passed.withColumn("overlaps", overlaps).filter(~F.col("overlaps")).drop("overlaps")


def link(found: DataFrame, scope_chars: int = SCOPE_CHARS) -> DataFrame:
    """The spans to report: base ones that pass, and weak ones whose complements co-occur in scope."""
    kinds = [d[0] for d in DETECTORS]
    passed = alone(found.filter("ok").select("doc_id", "digest", "kind", "start", "end"))
    name = F.element_at(F.array(*map(F.lit, kinds)), F.col("kind") + 1)
    bucket = lambda at: F.floor(at / F.lit(scope_chars))

    def near(weak: DataFrame, roles: tuple[str, ...]) -> DataFrame:
        parts = passed.filter(name.isin(*roles)).select(F.col("doc_id").alias("p_doc"), F.col("digest").alias("p_digest"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        parts = parts.withColumn("p_bucket", F.explode(F.sequence(bucket(F.col("p_start")), bucket(F.col("p_end")))))
        reach = weak.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.lit(0), F.col("start") - scope_chars)), bucket(F.col("end") + scope_chars))))
        within = (F.col("p_start") <= F.col("end") + scope_chars) & (F.col("p_end") >= F.col("start") - scope_chars)
        within &= (F.col("p_start") >= F.col("end")) | (F.col("p_end") <= F.col("start"))  # no string is its own complement
        same = (F.col("digest") == F.col("p_digest")) & F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("bucket") == F.col("p_bucket"))
        return reach.join(parts, same & within, "left_semi").drop("bucket").distinct()

    reported = [passed.filter(F.col("kind") < BASE)]
    for kind, needs in NEEDS.items():
        weak = passed.filter(F.col("kind") == kinds.index(kind))
        reported.append(reduce(near, needs, weak))
    return reduce(DataFrame.unionByName, reported)


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = staging.stage(candidates(docs, text, id_col), "candidates")
    spans = link(found)
    every = found.filter("at is null or at = 0").select("doc_id", "digest", "n_rows", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    rows = every.unionByName(spans.withColumn("n_rows", F.lit(None).cast("long"))).groupBy("doc_id", "digest").agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("s"))
    names = F.array(*(F.lit(d[0]) for d in DETECTORS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("s", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long")
    rows = rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("s")).alias("spans"), F.size(F.filter("s", lambda s: s["kind"] >= BASE)).cast("long").alias("n_linked"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"))
    return rows.drop("copy")
