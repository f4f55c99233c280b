"""DuckDB equivalents of the Merkle manifest and of the conversation trie, written for small tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"


def _crc32(value: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    step = "CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::BIGINT) ELSE z >> 1 END"
    byte = f"list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda z, i: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda c: ascii(c)::BIGINT)), lambda r, b: {byte}), 4294967295::BIGINT)"


def _trees(leaves: str, name: str) -> str:
    """Nodes of every level of the trees of ``leaves`` (tree, idx, dg), then their runs, and what each tree comes to."""
    return f"""{name}(tree, lvl, idx, dg, w) AS (SELECT tree, 0, idx, dg, count(*) OVER (PARTITION BY tree) FROM {leaves}
        UNION ALL SELECT tree, lvl + 1, idx // 16, sha256(string_agg(dg, '' ORDER BY idx)), any_value((w + 15) // 16) FROM {name} WHERE w > 1 GROUP BY tree, lvl, idx // 16),
    {name}_runs AS (SELECT tree, lvl, idx // 16 AS run, list(dg ORDER BY idx) AS dgs FROM {name} WHERE w > 1 GROUP BY ALL),
    {name}_top AS (SELECT tree, dg FROM {name} WHERE w = 1)"""


def _folded(name: str, start: str) -> str:
    """Climbs from ``start`` (row, tree, idx, acc, proof) to the tops of the trees."""
    return f"""{name}_up(row, tree, lvl, idx, acc, proof) AS (SELECT row, tree, 0, idx, acc, proof FROM {start}
        UNION ALL SELECT u.row, u.tree, u.lvl + 1, u.idx // 16, sha256(array_to_string(dgs[1:u.idx % 16] || [acc] || dgs[u.idx % 16 + 2:], '')), proof || array_to_string(dgs[1:u.idx % 16] || dgs[u.idx % 16 + 2:], '')
        FROM {name}_up u JOIN {name}_runs r ON r.tree IS NOT DISTINCT FROM u.tree AND r.lvl = u.lvl AND r.run = u.idx // 16),
    {name}_end AS (SELECT row, tree, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM {name}_up GROUP BY ALL)"""


def _merkle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    upper = "".join(map(chr, range(65, 91)))
    return f"""WITH RECURSIVE l AS (SELECT source AS tree, {leaf('text')} AS dg, translate(text, '{upper}', '{upper.lower()}') AS low, * FROM documents),
    f AS (SELECT doc_id, tree, dg, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf('low')} ELSE dg END AS acc, '' AS proof, row_number() OVER (ORDER BY doc_id NULLS FIRST, dg) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, dg) - 1 AS idx FROM l),
    {_trees('f', 'n')}, {_folded('n', 'f')},
    s AS (SELECT tree AS source, dg, 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx FROM n_top),
    {_trees('s', 't')},
    g AS (SELECT n_end.row, 0 AS tree, s.idx, n_end.acc, n_end.proof FROM n_end JOIN s ON s.source IS NOT DISTINCT FROM n_end.tree), {_folded('t', 'g')}
    SELECT f.doc_id, f.dg AS leaf, s.dg AS subroot, t_top.dg AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = t_top.dg AS verified
    FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.tree JOIN t_end e ON e.row = f.row, t_top"""


def _conversations() -> str:
    return rf"""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT conv_id, dg, len(regexp_extract_all(x, '{_WORD}')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS k FROM w),
    c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM t),
    b AS (SELECT c.conv_id, 0 AS own, k, dg, words FROM c JOIN t ON t.conv_id = c.base AND k <= h UNION ALL SELECT c.conv_id, 1, k, dg, words FROM c JOIN t USING (conv_id) WHERE k > h),
    d AS (SELECT conv_id, row_number() OVER o AS depth, words, string_agg(dg, '') OVER o AS prefix, count(*) OVER (PARTITION BY conv_id) AS turns FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY own, k)),
    m AS (SELECT * FROM d UNION ALL SELECT c.conv_id, 0, 0, '', (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) FROM c),
    n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '') AS ends FROM m GROUP BY prefix, depth),
    k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND starts_with(x.prefix, n.prefix)) AS n_children FROM n),
    u AS (SELECT a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own)::BIGINT AS saved_tokens FROM k a JOIN k b ON starts_with(b.prefix, a.prefix) GROUP BY a.prefix)
    SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(k.ends) AS ends_sha256
    FROM k JOIN u USING (prefix) LEFT JOIN n p ON p.depth = k.depth - 1 AND starts_with(k.prefix, p.prefix)"""


ORACLES = {"op11_merkle_manifest": _merkle(), "op13_prefix_trie": _conversations()}
