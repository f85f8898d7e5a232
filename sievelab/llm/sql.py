"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

CRC_INVERTED = 4294967295  # 2^32 - 1, where crc32 starts and what its result is inverted with
CRC_POLYNOMIAL = 3988292384
NO_BYTE = 4294967296  # in a list of bytes: shift the remainder by one bit


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: each byte is added to the remainder, which is then shifted eight times."""
    shifts = ", ".join([str(NO_BYTE)] * 8)
    byte = f"(strpos('0123456789ABCDEF', substr(hex({text}), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex({text}), 2 * i + 2, 1)) - 1"
    steps = f"flatten(list_transform(range(0, strlen({text})), lambda i: [CAST({byte} AS UBIGINT), {shifts}]))"
    step = f"CASE WHEN x < {NO_BYTE} THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * {CRC_POLYNOMIAL}) END"
    return f"xor(list_reduce(list_concat([CAST({CRC_INVERTED} AS UBIGINT)], {steps}), lambda c, x: {step}), {CRC_INVERTED})"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _grown(name: str, keys: str, start: str) -> str:
    """The nodes of each level of the trees that ``start`` (keys, pos, n, h) are the leaves of."""
    head = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {head}0 AS level, pos, n, h FROM {start}
  UNION ALL
  SELECT {head}level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY {head}level, pos // 3, n)"""


MERKLE = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS h,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS presented
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER () AS rid FROM hashed),
{_grown("tree", "source", "leaves")},
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{_grown("over", "", "subroots")},
runs AS (
  SELECT l.rid, 0 AS part, t.level, t.pos, t.h, l.pos // CAST(3 ** t.level AS BIGINT) AS own
  FROM leaves l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 3 = l.pos // CAST(3 ** (t.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.rid, 1, t.level, t.pos, t.h, s.pos // CAST(3 ** t.level AS BIGINT)
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN over t ON t.n > 1 AND t.pos // 3 = s.pos // CAST(3 ** (t.level + 1) AS BIGINT)),
proofs AS (
  SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY part, level, pos) FILTER (WHERE pos <> own), '')) AS proof FROM runs GROUP BY rid),
steps AS (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, level) AS step,
    coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS before,
    coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS behind
  FROM runs GROUP BY rid, part, level),
folded AS (
  SELECT rid, CAST(0 AS BIGINT) AS step, presented AS h FROM leaves
  UNION ALL
  SELECT f.rid, s.step, sha256(s.before || f.h || s.behind) FROM folded f JOIN steps s ON s.rid = f.rid AND s.step = f.step + 1),
ends AS (SELECT rid, arg_max(h, step) AS h FROM folded GROUP BY rid)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaves l JOIN ends e ON e.rid = l.rid JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
CROSS JOIN (SELECT h FROM over WHERE n = 1) r LEFT JOIN proofs p ON p.rid = l.rid
"""

SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name,
    translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
distinct_runs AS (SELECT name || ':' || run AS whole, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("whole")} AS h FROM distinct_runs),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
lost AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM lost a JOIN lost b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM lost l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM lost l JOIN words w ON w.word = l.rest),
ranked AS (
  SELECT x.word, x.near, w.n AS near_n, count(*) OVER (PARTITION BY x.word) AS n_near,
    row_number() OVER (PARTITION BY x.word ORDER BY w.n DESC, x.near) AS place
  FROM near x JOIN words w ON w.word = x.near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""

NEAR_DUPLICATES = """
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM listed),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS node FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.node),
least AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON l.doc_id = s.doc_id
"""

LLM_SQL = {
    "op6_tensored_minhash": NEAR_DUPLICATES,
    "op12_merkle_manifest": MERKLE,
    "op13_spelling_variants": SPELLING,
}
