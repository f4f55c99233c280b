"""DuckDB equivalents of the training-data queries that SQL can express, written for small tables."""

from __future__ import annotations

from veilmark.llm import license_scan, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Candidates from split and match lists, positions as prefix sums, links as semi joins within the scope."""
    parts = []
    for kind, (name, pattern, group, least) in enumerate(secret_scan.DETECTORS):
        p = _quoted(pattern)
        must = "".join(f" AND regexp_matches(whole, {_quoted(m)})" for m in secret_scan.MUST.get(name, ()))
        lists = f"SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS g, regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})"
        rows = f"SELECT doc_id, unnest(m) AS whole, unnest(g) AS counted, unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM ({lists})"
        sums = f"SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM ({rows})"
        parts.append(f"SELECT doc_id, {kind} AS kind, '{name}' AS name, (stop - length(whole))::BIGINT AS start, stop::BIGINT AS stop FROM ({sums}) WHERE length(counted) >= {least}{must}")
    near = lambda roles: "EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND b.name IN (" + ", ".join(map(_quoted, roles)) + f") AND (b.start >= a.stop OR b.stop <= a.start) AND b.start <= a.stop + {secret_scan.SCOPE_CHARS} AND b.stop >= a.start - {secret_scan.SCOPE_CHARS})"
    weak = " OR ".join(f"(name = '{k}' AND " + " AND ".join(map(near, needs)) + ")" for k, needs in secret_scan.NEEDS.items())
    said = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({' UNION ALL '.join(parts)}),
    c AS (SELECT * FROM k a WHERE name <> 'opaque' OR NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.name <> 'opaque' AND b.start < a.stop AND b.stop > a.start)),
    s AS (SELECT * FROM c a WHERE kind < {secret_scan.BASE} OR {weak}),
    g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind >= {secret_scan.BASE}) AS n_linked,
        {said} FILTER (kind < {secret_scan.BASE}) AS base, {said} AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
    FROM d LEFT JOIN g USING (doc_id)"""


def _canonical(text: str) -> str:
    """Line by line: what is a line of a notice goes, by rules of its own; then spellings and punctuation."""
    begins = "[^a-zA-Z0-9(©]*"
    rules = (
        rf"regexp_matches(l, '(?i)^{begins}copyright[ \t:,]*(\(c\)|©|[0-9]{{4}})')", rf"regexp_matches(l, '^{begins}(\([cC]\)|©)[ \t]*[0-9]{{4}}')",
        rf"(regexp_matches(l, '^{begins}Copyright[ \t]+([Bb]y[ \t]+)?[A-Z]') AND NOT regexp_matches(l, '^{begins}Copyright[ \t]+([Bb]y[ \t]+)?(Holder|Owner|Licen|Notice|Law|Act|Statement|Interest|Right|And|Or|In|Is)\b'))",
        r"regexp_matches(l, '(?i)^[^a-z0-9]*all[ \t]+rights[ \t]+reserved[^a-z0-9]*$')",
    )
    out = f"lower(array_to_string(list_filter(string_split({text}, chr(10)), lambda l: NOT ({' OR '.join(rules)})), chr(10)))"
    for pattern, to in license_scan.SPELLINGS:
        out = f"replace({out}, {_quoted(pattern)}, {_quoted(to)})"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _licenses() -> str:
    """Every line and paragraph is normalised and looked up, without any test before."""
    values = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in license_scan.TEXTS)
    return rf"""WITH v(name, known) AS (VALUES {values}), k AS (SELECT sha256({_canonical('known')}) AS digest, min(name) AS license FROM v GROUP BY 1),
    d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM d UNION ALL SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[\x20\t]*\n\s*')) AS u FROM d) WHERE contains(u, chr(10))),
    h AS (SELECT doc_id, license FROM (SELECT doc_id, sha256({_canonical('u')}) AS digest FROM x) JOIN k USING (digest)),
    o AS (SELECT doc_id, sha256({_canonical('t')}) AS doc_digest FROM d),
    p AS (SELECT o.*, k.license AS doc_license FROM o LEFT JOIN k ON k.digest = doc_digest),
    a AS (SELECT doc_id, license FROM h UNION SELECT doc_id, doc_license FROM p WHERE doc_license IS NOT NULL)
    SELECT doc_id, doc_digest, doc_license, coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM a WHERE a.doc_id = p.doc_id), '') AS licenses, (SELECT count(*) FROM h WHERE h.doc_id = p.doc_id) AS n_units FROM p"""


#: Reachable nodes of the links of e(a, b), both ways.
_REACHED = """r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a, min(b) AS component FROM r GROUP BY a)"""

_EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    e AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.9), {_REACHED}
    SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN m ON m.a = vec_id"""

_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM s p JOIN s q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)), {_REACHED}
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id"""

_WINDOWS = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
    g AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
    j AS (SELECT g.*, max(f.i) OVER (PARTITION BY g.doc_id ORDER BY g.p ROWS UNBOUNDED PRECEDING) AS last FROM g LEFT JOIN f ON f.doc_id = g.doc_id AND f.i = g.p),
    k AS (SELECT doc_id, count(*) FILTER (p - last < 20) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR p - last >= 20) AS kept FROM j GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

#: Texts in hexadecimal, two characters a byte, so that a window is a substring.
_BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS m FROM (SELECT doc_id, h, unnest(generate_series(1, length(h)::BIGINT // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
    g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM f),
    r AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM (SELECT doc_id, i, count(*) FILTER (step IS NULL OR step > 100) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
    n AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
    e AS (SELECT doc_id, low, high FROM r UNION ALL SELECT doc_id, length(h) // 2 + 1, length(h) // 2 + 1 FROM d),
    k AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high), 1) AS start, low AS stop FROM e),
    t AS (SELECT k.doc_id, string_agg(substr(h, 2 * start - 1, 2 * (stop - start)), '' ORDER BY start) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
    SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""

_COPIES = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

ORACLES = {
    "op1_secret_scan": _secrets(),
    "op4_suffix_dedup": _BYTES,
    "op5_pivot_index": _EMBEDDINGS,
    "op7_license_scan": _licenses(),
    "op8_jaccard_join": _JACCARD,
    "op9_fingerprint_index": _WINDOWS,
    "op10_exact_dedup": _COPIES,
}
