"""The SQL of the Merkle manifest: the same trees and proofs, level by level, without pointers."""

from __future__ import annotations

#: Levels that the SQL writes out, in a group and above the groups; 8**LEVELS leaves.
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


#: crc32 of the id's digits: the remainders of single bytes, and their reduction over the text.
_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
_BYTES = "list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    value = lambda c: text if c == "text" else f"CAST({c} AS VARCHAR)"
    return "sha256(concat(" + ", ".join(f"coalesce(CAST(octet_length(encode({value(c)})) AS VARCHAR) || ':' || {value(c)}, '-')" for c in FIELDS) + "))"


def _tree(name: str, leaves: str) -> str:
    """Levels ``name``0, ... of nodes (t, i, node, n: nodes of the level) and runs ``name``r0, ... of eight."""
    out = [f"{name}0 AS MATERIALIZED (SELECT t, i, node, count(*) OVER (PARTITION BY t) AS n FROM ({leaves}))"]
    for k in range(LEVELS):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT t, i // 8 AS i, list(node ORDER BY i) AS run, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {name}{k} WHERE n > 1 GROUP BY t, i // 8)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, i, node, count(*) OVER (PARTITION BY t) AS n FROM {name}r{k})")
    tops = " UNION ALL ".join(f"SELECT t, node FROM {name}{k} WHERE n = 1" for k in range(LEVELS + 1))
    return ",\n".join([*out, f"{name}top AS MATERIALIZED ({tops})"])


def _climb(name: str, tree: str, start: str) -> str:
    """The proof so far and the folded node of each row of ``start`` (row, t, i, proof, node), up ``tree``."""
    out, last = [], start
    for k in range(LEVELS):
        left, right = "array_to_string(run[:p.i % 8], '')", "array_to_string(run[p.i % 8 + 2:], '')"
        proof, node = f"{left} || {right}", f"sha256({left} || p.node || {right})"
        out.append(f"{name}{k} AS (SELECT p.row, p.t, p.i // 8 AS i, CASE WHEN r.run IS NULL THEN p.proof ELSE p.proof || {proof} END AS proof, CASE WHEN r.run IS NULL THEN p.node ELSE {node} END AS node FROM {last} p LEFT JOIN {tree}r{k} r ON p.t = r.t AND p.i // 8 = r.i)")
        last = f"{name}{k}"
    return ",\n".join(out)


OP11_SQL = f"""
WITH d0 AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed, {_CRC} % 3 = 0 AS tampered
FROM documents, (SELECT {_TABLE} AS tab)),
l AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT lang FROM d0)),
d AS MATERIALIZED (SELECT d0.*, l.t, row_number() OVER (PARTITION BY l.t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS row FROM d0 JOIN l ON d0.lang IS NOT DISTINCT FROM l.lang),
{_tree("a", "SELECT t, i, leaf AS node FROM d")},
{_tree("b", "SELECT 0 AS t, t AS i, node FROM atop")},
s AS (SELECT row, t, i, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM d),
{_climb("u", "a", "s")},
s2 AS (SELECT u.row, 0 AS t, d.t AS i, u.proof, u.node FROM u{LEVELS - 1} u JOIN d ON u.row = d.row),
{_climb("v", "b", "s2")}
SELECT d.doc_id, d.leaf, atop.node AS subroot, btop.node AS root, sha256(v.proof) AS proof_sha256, v.node AS folded_root, v.node = btop.node AS verified
FROM v{LEVELS - 1} v JOIN d ON v.row = d.row JOIN atop ON d.t = atop.t, btop
"""
