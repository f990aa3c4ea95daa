"""SQL for the training-data queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

from emberlake.llm import licenses, quality, sharding, templates

_WORD = r"[^\x20\x09-\x0D]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def quality_rules() -> str:
    stop = ", ".join(map(_text, dict.fromkeys(quality.STOP_WORDS)))
    bounds = [f"{measure} {op} {bound}" for _, measure, least, most in quality.RULES for op, bound in ((">=", least), ("<=", most)) if bound is not None]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM t),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS rep FROM g),
c AS (SELECT doc_id, count(*) FILTER (WHERE covered) AS n_repeat_words FROM (SELECT doc_id, rep OR coalesce(lag(rep, 1) OVER o, false) OR coalesce(lag(rep, 2) OVER o, false) AS covered FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id),
m AS (SELECT w.doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) AS bigint) AS n_symbols,
             cast(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines, cast(coalesce(n_repeat_words, 0) AS bigint) AS n_repeat_words,
             len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '{quality.ELLIPSIS}'))) AS n_ellipsis, len(list_filter(ls, lambda x: length(x) < {quality.SHORT})) AS n_short
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             n_upper / greatest(word_chars, 1) AS upper_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
             n_bullet / greatest(n_lines, 1) AS bullet_ratio, n_ellipsis / greatest(n_lines, 1) AS ellipsis_ratio, n_short / greatest(n_lines, 1) AS short_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM v"""


def license_scan(least: float = licenses.LEAST) -> str:
    known = ", ".join(f"({_text(name)}, {len(grams)}, [{', '.join(map(_text, grams))}])" for name, _, grams in licenses.template_bigrams(licenses.TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH k(license, size, grams) AS (VALUES {known}),
p AS (SELECT doc_id, text, string_split_regex(text, '{licenses.SENTENCE}') AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{licenses.PARAGRAPH}'))) AS unit FROM p UNION SELECT doc_id, text FROM p
      UNION SELECT doc_id, array_to_string(s[i:i + k - 1], ' ') FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p), range(1, {licenses.SENTENCES + 1}) AS r(k)),
w AS (SELECT doc_id, unit, regexp_extract_all(translate(unit, '{upper}', '{lower}'), '[a-z0-9]+') AS w FROM u),
b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2),
d AS (SELECT doc_id, unit, license, len(b) AS n, 2 * len(list_intersect(b, grams)) / (len(b) + size) AS dice FROM b JOIN k ON len(b) BETWEEN size * {least} / (2 - {least}) AND size * (2 - {least}) / {least}),
e AS (SELECT *, max(dice) OVER (PARTITION BY doc_id, unit) AS top FROM d WHERE dice >= {least}),
v AS (SELECT doc_id, unit, n, top AS dice, string_agg(DISTINCT license, '/' ORDER BY license) AS license FROM e WHERE dice >= top - {licenses.MARGIN} GROUP BY doc_id, unit, n, top),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, n DESC, license DESC, unit DESC) AS place FROM v),
n AS (SELECT doc_id, count(DISTINCT unit) AS n_notices FROM h GROUP BY doc_id)
SELECT documents.doc_id, h.license, round(h.dice, 6) AS dice, coalesce(n.n_notices, 0) AS n_notices, h.unit
FROM documents LEFT JOIN h ON documents.doc_id = h.doc_id AND h.place = 1 LEFT JOIN n ON documents.doc_id = n.doc_id"""


def shard_placement(size: int = sharding.TABLE_SIZE) -> str:
    n = len(sharding.SHARDS)
    names = ", ".join(f"({k}, {_text(s)})" for k, s in enumerate(sharding.SHARDS))
    number = lambda x: f"cast('0x' || substr(md5({x}), 1, 8) AS bigint)"
    return f"""
WITH RECURSIVE s(k, name) AS (VALUES {names}),
p AS (SELECT k, j, ({number("name || '/offset'")} % {size} + j * ({number("name || '/skip'")} % {size - 1} + 1)) % {size} AS slot FROM s, range({size}) AS t(j)),
claims(turn, owner) AS (
  SELECT 0, list_transform(range({size}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(owner[1:best], [turn % {n}]), owner[best + 2:])
  FROM (SELECT turn, owner, (SELECT arg_min(p.slot, p.j) FROM p WHERE p.k = turn % {n} AND owner[p.slot + 1] = -1) AS best FROM claims WHERE turn < {size})),
o AS (SELECT unnest(owner) AS shard, generate_subscripts(owner, 1) - 1 AS slot FROM claims WHERE turn = {size}),
d AS (SELECT doc_id, n_chars, {number("coalesce(cast(doc_id AS varchar), '')")} % {size} AS slot FROM documents)
SELECT d.doc_id, cast(d.slot AS integer) AS slot, cast(o.shard AS integer) AS shard, d.n_chars FROM d JOIN o ON d.slot = o.slot"""


def line_dedup(least: int = templates.MIN_TEXTS, similarity: float = templates.SIMILARITY, depth: int = templates.DEPTH) -> str:
    return rf"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM s),
x AS (SELECT doc_id, text, no, regexp_extract_all(raw, '{_WORD}+') AS rw FROM l),
m AS (SELECT doc_id, text, no, rw, list_transform(rw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM x WHERE len(rw) > 0),
k AS (SELECT doc_id, text, no, w, len(w) AS n, array_to_string(rw, ' ') AS spelt, array_to_string(w, ' ') AS line, array_to_string(w[1:{depth}], ' ') AS lead, len(list_filter(w, lambda x: x <> '<*>')) < {similarity} * len(w) AS loose FROM m),
lt AS (SELECT DISTINCT line, w, n, lead, text FROM k),
f AS (SELECT n, lead FROM lt GROUP BY ALL HAVING count(DISTINCT text) >= {least}),
a AS (SELECT DISTINCT lt.line, lt.w, lt.n, lt.lead FROM lt JOIN f USING (n, lead)),
b AS (SELECT line, n, lead, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM a),
fx AS (SELECT b.n, b.lead, b.place, b.token FROM b JOIN (SELECT DISTINCT line, text FROM lt) o ON b.line = o.line WHERE place > {depth} AND token <> '<*>' GROUP BY ALL HAVING count(DISTINCT o.text) >= {least}),
g AS (SELECT b.line, b.n, b.place, b.token, CASE WHEN b.place <= {depth} OR fx.token IS NOT NULL THEN b.token ELSE '<*>' END AS shown
      FROM b LEFT JOIN fx ON b.n = fx.n AND b.lead = fx.lead AND b.place = fx.place AND b.token = fx.token),
t AS (SELECT line, CASE WHEN count(*) FILTER (WHERE shown <> '<*>') >= {similarity} * any_value(n) THEN string_agg(shown, ' ' ORDER BY place) ELSE line END AS template FROM g GROUP BY line
      HAVING count(*) FILTER (WHERE token <> '<*>') >= {similarity} * any_value(n)),
p AS (SELECT template FROM t JOIN (SELECT DISTINCT line, text FROM lt) o ON t.line = o.line GROUP BY template HAVING count(DISTINCT o.text) >= {least}),
r AS (SELECT line FROM t WHERE template IN (SELECT template FROM p)),
e AS (SELECT spelt FROM k WHERE loose GROUP BY spelt HAVING count(DISTINCT text) >= {least}),
z AS (SELECT doc_id, list(no) AS nos FROM k WHERE (NOT loose AND line IN (SELECT line FROM r)) OR (loose AND spelt IN (SELECT spelt FROM e)) GROUP BY doc_id),
q AS (SELECT documents.doc_id, documents.text, string_split(documents.text, chr(10)) AS ls, z.nos FROM documents LEFT JOIN z ON documents.doc_id = z.doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(nos), 0) AS n_dropped,
       md5(CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(nos, i)), lambda i: ls[i]), chr(10)) END) AS text_md5 FROM q"""


def mixing(weights: list[dict[str, float]], share: float, max_epochs: float, seed: int = 7) -> str:
    """The water level of a node's children in closed form: sorted by capacity over weight, the first that isn't full sets it."""
    weight = lambda level, name: f"CASE {name} {' '.join(f'WHEN {_text(k)} THEN {w}' for k, w in weights[level].items())} ELSE 1.0 END" if weights[level] else "1.0"

    def filled(nodes: str, parent: str, out: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY cap / w, name"
        return f"""
{out}_o AS (SELECT *, budget - (sum(cap) OVER ({over}) - cap) AS above, sum(w) OVER (PARTITION BY {parent}) - (sum(w) OVER ({over}) - w) AS open_w FROM {nodes}),
{out}_l AS (SELECT {parent}, arg_min(above / open_w, struct_pack(r := cap / w, name := name)) AS water FROM {out}_o WHERE cap > w * above / open_w GROUP BY ALL),
{out} AS (SELECT o.* EXCLUDE (budget, above, open_w), CASE WHEN o.cap <= o.w * o.above / o.open_w OR l.water IS NULL THEN o.cap ELSE o.w * l.water END AS given
          FROM {out}_o o LEFT JOIN {out}_l l ON {' AND '.join(f'o.{p} = l.{p}' for p in parent.split(', '))}),"""

    return rf"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'forum' WHEN source IS NOT NULL THEN 'books' ELSE '(none)' END AS d,
                  coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}+')) AS bigint) AS n, md5(coalesce(text, '')) AS body FROM documents),
leaf AS (SELECT 0 AS root, d, l, s, cast(sum(n) AS double) AS tokens FROM t GROUP BY ALL),
n1 AS (SELECT root, d AS name, {weight(0, 'd')} AS w, sum(tokens) * {max_epochs} AS cap, (SELECT sum(tokens) * {share} FROM leaf) AS budget FROM leaf GROUP BY root, d),
{filled('n1', 'root', 'f1')}
n2 AS (SELECT leaf.d, leaf.l AS name, {weight(1, 'leaf.l')} AS w, sum(tokens) * {max_epochs} AS cap, any_value(f1.given) AS budget FROM leaf JOIN f1 ON leaf.d = f1.name GROUP BY leaf.d, leaf.l),
{filled('n2', 'd', 'f2')}
n3 AS (SELECT leaf.d, leaf.l, leaf.s AS name, {weight(2, 'leaf.s')} AS w, tokens * {max_epochs} AS cap, f2.given AS budget FROM leaf JOIN f2 ON leaf.d = f2.d AND leaf.l = f2.name),
{filled('n3', 'd, l', 'f3')}
b AS (SELECT leaf.*, CASE WHEN tokens > 0 THEN cast(floor(f3.given / tokens + 1e-6) AS bigint) ELSE 0 END AS whole, f3.given FROM leaf JOIN f3 ON leaf.d = f3.d AND leaf.l = f3.l AND leaf.s = f3.name),
k AS (SELECT t.*, whole, cast(floor(given - whole * tokens + 1e-6) AS bigint) AS room, cast('0x' || substr(md5('{seed}/' || cast(whole AS varchar) || '/' || md5(coalesce(cast(doc_id AS varchar), '(none)') || '/' || body)), 1, 15) AS bigint) AS place
      FROM t JOIN b ON t.d = b.d AND t.l = b.l AND t.s = b.s),
u AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, d || '/' || l || '/' || s AS leaf, n AS n_tokens, cast(whole + CASE WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END AS integer) AS epochs FROM u WHERE whole > 0 OR (room > 0 AND upto <= room)"""
