"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII string expression."""
    step = "xor(v >> 1, 3988292384 * (v & 1))"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {step})"
    codes = f"list_transform(str_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}))"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(name: str, rows: str) -> str:
    """Levels of trees from their lowest rows (tree, level, n, idx, h), and each node's siblings."""
    return f"""
{name} AS (
  {rows}
  UNION ALL
  SELECT tree, level + 1, (n + 15) // 16, idx // 16, sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, level, n, idx // 16),
{name}_sides AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"""


def _climb(name: str, start: str, sides: str) -> str:
    """From (row, tree, level, idx, fold, proof) up to where a node has no siblings' row any more."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT c.row, c.tree, c.level + 1, c.idx // 16, sha256(s.before || c.fold || s.after), c.proof || s.before || s.after
  FROM {name} c JOIN {sides} s ON c.tree = s.tree AND c.level = s.level AND c.idx = s.idx)"""


OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row, doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_HEAD} || {_field(_LOWER)}) END AS changed
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx
  FROM leaves),
{_levels("low", "SELECT tree, 0 AS level, n, idx, leaf AS h FROM placed")},
subroots AS (SELECT tree, h FROM low WHERE n = 1),
{_levels("top", "SELECT 0 AS tree, 0 AS level, (SELECT count(*) FROM subroots) AS n, tree AS idx, h FROM subroots")},
{_climb("lower_climb", "SELECT row, tree, 0 AS level, idx, coalesce(changed, leaf) AS fold, '' AS proof FROM placed", "low_sides")},
lower_end AS (SELECT row, tree, max_by(fold, level) AS fold, max_by(proof, level) AS proof FROM lower_climb GROUP BY row, tree),
{_climb("upper_climb", "SELECT row, 0 AS tree, 0 AS level, tree AS idx, fold, proof FROM lower_end", "top_sides")},
upper_end AS (SELECT row, max_by(fold, level) AS fold, max_by(proof, level) AS proof FROM upper_climb GROUP BY row)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.fold AS folded_root, u.fold = r.h AS verified
FROM placed p JOIN upper_end u ON p.row = u.row JOIN subroots s ON s.tree = p.tree, (SELECT h FROM top WHERE n = 1) r
"""

#: Runs as diagonals over all pairs of equal six words in a row: quadratic where a text repeats itself, so for small tables.
OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS original,
         {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents),
sized AS (SELECT row, doc_id, original, len(original) AS n, h % 10 = 0 AND len(original) > 0 AS synthetic, h // 10 AS g FROM docs),
tails AS (SELECT *, CASE WHEN synthetic THEN g % n ELSE n END AS a,
                 CASE WHEN synthetic THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM sized),
made AS (
  SELECT row, doc_id, n, list_transform(range(n), lambda i: original[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) AS words
  FROM tails),
placed AS (SELECT row, unnest(range(n)) AS i, unnest(words) AS w FROM made),
grams AS (
  SELECT row, i, w || chr(31) || lead(w, 1) OVER o || chr(31) || lead(w, 2) OVER o || chr(31) || lead(w, 3) OVER o
         || chr(31) || lead(w, 4) OVER o || chr(31) || lead(w, 5) OVER o AS gram
  FROM placed WINDOW o AS (PARTITION BY row ORDER BY i)),
pairs AS (
  SELECT b.row, b.i - a.i AS lag, b.i FROM grams a JOIN grams b ON a.row = b.row AND a.gram = b.gram AND a.i < b.i
  WHERE a.gram IS NOT NULL),
diagonals AS (
  SELECT row, lag, min(i) - lag AS start, max(i) - min(i) + 6 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, lag ORDER BY i) AS island FROM pairs) GROUP BY row, lag, island),
runs AS (
  SELECT row, start, length, min(lag) AS period FROM diagonals WHERE length >= 12 AND length >= 2 * lag GROUP BY row, start, length),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT p.row, string_agg(p.w, ' ' ORDER BY p.i) AS collapsed FROM placed p ANTI JOIN gone g ON p.row = g.row AND p.i = g.i GROUP BY p.row),
listed AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min_by({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best
  FROM runs GROUP BY row)
SELECT m.doc_id, coalesce(l.n_runs, 0) AS n_runs, l.best.start AS start, l.best.length AS length, l.best.period AS period,
       1000 * l.best.length // l.best.period AS exponent_milli, sha256(coalesce(l.lines, '')) AS runs_sha256,
       sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM made m LEFT JOIN listed l ON m.row = l.row LEFT JOIN kept k ON m.row = k.row
"""


def _reached(rows: str, node: str) -> str:
    """(x, component_id) of every node of ``rows`` from the table ``links`` (x, y), both directions, each node linked to itself."""
    return f"""
reached AS (
  SELECT {node} AS x, {node} AS y FROM {rows}
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
components AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)"""


OP5 = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * c >= 90 * (n + m - c)),{_reached("sets", "doc_id")}
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM sets s JOIN components c ON c.x = s.doc_id
"""

OP8 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x),{_reached("embeddings", "vec_id")}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN components c ON c.x = e.vec_id LEFT JOIN counts n ON n.x = e.vec_id
"""
