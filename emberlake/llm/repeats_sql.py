"""SQL of the removal of repeated strings: every window of every text, counted by its digest."""

from __future__ import annotations

from emberlake.llm.repeats import LENGTH


def removal(length: int = LENGTH) -> str:
    steps = [
        "docs AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents)",
        # blocks of 500 windows, so that no window is cut from a long text
        f"blocks AS (SELECT row, n_bytes, c, substr(hx, 1000 * c + 1, {2 * length + 998}) AS block FROM (SELECT row, n_bytes, hx, unnest(range((n_bytes - {length}) // 500 + 1)) AS c FROM docs WHERE n_bytes >= {length}))",
        f"windows AS (SELECT row, 500 * c + j AS k, md5(substr(block, 2 * j + 1, {2 * length})) AS digest FROM (SELECT row, c, block, unnest(range(least(500, n_bytes - {length - 1} - 500 * c))) AS j FROM blocks))",
        "repeated AS (SELECT row, k FROM windows JOIN (SELECT digest FROM windows GROUP BY digest HAVING count(*) > 1) USING (digest))",
        f"parted AS (SELECT row, k, CASE WHEN k <= lag(k) OVER (PARTITION BY row ORDER BY k) + {length} THEN 0 ELSE 1 END AS opens FROM repeated)",
        "numbered AS (SELECT row, k, sum(opens) OVER (PARTITION BY row ORDER BY k) AS span FROM parted)",
        f"spans AS (SELECT row, span, min(k) AS a, max(k) + {length} AS b FROM numbered GROUP BY row, span)",
        # what stands before a span, and after the last
        "gaps AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS begins FROM spans)",
        "cut AS (SELECT d.row, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * begins + 1, 2 * (a - begins)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS kept FROM gaps JOIN docs d USING (row) GROUP BY d.row)",
    ]
    last = "SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM docs LEFT JOIN cut USING (row)"
    return "WITH " + ",\n".join(steps) + "\n" + last
