"""SQL of the Merkle manifest: its levels unrolled, and of the CRC-32 that SQL has no function for."""

from __future__ import annotations

#: Levels of a language's tree and of the tree of subroots: 8 to the seventh leaves, 8 to the third languages.
DEPTH, CROWN = 7, 3


def crc32_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b))"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: {bits}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _climb(name: str, depth: int) -> list[str]:
    """From ``{name}0`` (tree, idx, digest, width) the levels above, and the runs of each level; a tree that is done stays."""
    out = []
    for k in range(depth):
        out.append(f"{name}runs{k} AS (SELECT tree, idx // 8 AS run, list(digest ORDER BY idx) AS run_digests FROM {name}{k} WHERE width > 1 GROUP BY ALL)")
        merged = f"SELECT r.tree, r.run AS idx, sha256(array_to_string(r.run_digests, '')) AS digest, (w.width + 7) // 8 AS width FROM {name}runs{k} r JOIN (SELECT DISTINCT tree, width FROM {name}{k}) w USING (tree)"
        out.append(f"{name}{k + 1} AS ({merged} UNION ALL SELECT tree, idx, digest, width FROM {name}{k} WHERE width = 1)")
    return out


def _walk(name: str, depth: int, first: str, last: str) -> list[str]:
    """Rows of ``first`` (with tree, idx, own, proof) up the levels of ``name``: siblings are added to proof, own is folded."""
    out, now = [], first
    for k in range(depth):
        after = last if k == depth - 1 else f"{name}walk{k}"
        pos = "(p.idx % 8)::INT"
        before = f"array_to_string(run_digests[1:{pos}], '')"
        behind = f"array_to_string(run_digests[{pos} + 2:], '')"
        out.append(
            f"{after} AS (SELECT p.* EXCLUDE (idx, own, proof), CASE WHEN run_digests IS NULL THEN p.idx ELSE p.idx // 8 END AS idx, "
            f"CASE WHEN run_digests IS NULL THEN p.own ELSE sha256({before} || p.own || {behind}) END AS own, "
            f"CASE WHEN run_digests IS NULL THEN p.proof ELSE p.proof || {before} || {behind} END AS proof "
            f"FROM {now} p LEFT JOIN {name}runs{k} r ON r.tree = p.tree AND r.run = p.idx // 8)"
        )
        now = after
    return out


def manifest() -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{capitals}', '{capitals.lower()}')"
    steps = [
        f"made AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents)",
        "langs AS (SELECT lang, count(*) AS width, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM made GROUP BY lang)",
        "leaves AS (SELECT m.*, l.tree, l.width, row_number() OVER (PARTITION BY l.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM made m JOIN langs l ON m.lang IS NOT DISTINCT FROM l.lang)",
        "inner0 AS (SELECT tree, idx, leaf AS digest, width FROM leaves)",
        *_climb("inner", DEPTH),
        f"subroots AS (SELECT tree, digest AS subroot FROM inner{DEPTH})",
        "outer0 AS (SELECT -1 AS tree, tree AS idx, subroot AS digest, (SELECT count(*) FROM langs) AS width FROM subroots)",
        *_climb("outer", CROWN),
        f"root AS (SELECT digest AS root FROM outer{CROWN})",
        "start AS (SELECT doc_id, leaf, tree, idx, coalesce(changed, leaf) AS own, '' AS proof FROM leaves)",
        *_walk("inner", DEPTH, "start", "inside"),
        "turn AS (SELECT i.doc_id, i.leaf, s.subroot, -1 AS tree, i.tree AS idx, i.own, i.proof FROM inside i JOIN subroots s USING (tree))",
        *_walk("outer", CROWN, "turn", "done"),
    ]
    last = "SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM done, root"
    return "WITH " + ",\n".join(steps) + "\n" + last
