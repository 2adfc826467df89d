"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '{_WORD}')"


ORACLE: dict[str, str] = {}

ORACLE["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS key
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM sized)),
sizes AS (SELECT DISTINCT k FROM sized),
places AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, p.k, s, item_id FROM places p JOIN windows x ON p.k = x.k AND p.key = x.key),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS place FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE["op8_cover_tree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# CRC-32 of a short ASCII string: its table by the polynomial's rule, then one step a byte.
_CRC_TABLE = """
crc_steps AS (
  SELECT byte, 0 AS step, CAST(byte AS BIGINT) AS v FROM range(256) r(byte)
  UNION ALL SELECT byte, step + 1, CASE WHEN (v & 1) = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS t FROM crc_steps WHERE step = 8)"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32, in a query that has ``crc`` in its FROM."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce({codes}, lambda acc, b: xor(acc >> 8, crc.t[(xor(acc, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


ORACLE["op11_prefix_trie"] = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (
  SELECT conv_id, role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, substring(role, 1, 64), substring(text, 1, 64), sha256(length(role) || ':' || role || text)) AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
taken AS (
  SELECT c.conv_id, 0 AS own, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.n > c.h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS depth FROM taken),
keyed AS (
  SELECT conv_id, depth, text, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (
    PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, text, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM keyed
  UNION ALL SELECT conv_id, 0, '', '', NULL FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY 1),
nodes AS (
  SELECT node, p.depth, any_value(parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved,
    coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.depth = p.depth), '') AS ends
  FROM prefixes p JOIN lengths l ON p.conv_id = l.conv_id GROUP BY node, p.depth),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT p.node, d.node AS lower FROM nodes d JOIN prefixes q ON q.conv_id = d.conv_id AND q.depth <= d.depth JOIN nodes p ON p.node = q.node),
sums AS (
  SELECT b.node, sum(d.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM below b JOIN nodes d ON d.node = b.lower LEFT JOIN children c ON c.node = d.node GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes u ON u.node = n.parent
"""


def _edit(state: str, cost: str, edit: str, out: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {state}.r || {out}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


_INSERTED = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
_SET = {"user": "chr(10) || 'user:' || text", "assistant": "chr(10) || 'assistant:' || text"}
_KEPT = "chr(10) || role || ':' || text"


def _step(state: int) -> str:
    """Best way to an output state by one row, from the states i0 to i3 before it: nothing, s, u, a."""
    keep = {1: [("s", 0)], 2: [("u", 0), ("u", 1), ("u", 3)], 3: [("a", 2)]}.get(state, [])
    turns = {2: ("user", (0, 1, 3)), 3: ("assistant", (2,))}.get(state, ("", ()))
    kept = [f"CASE WHEN ok AND left(role, 1) = '{x}' THEN {_edit(f'i{i}', 'more', 'K', _KEPT)} END" for x, i in keep]
    set_ = [f"CASE WHEN ok THEN {_edit(f'i{i}', '3 + more', 'R', _SET[turns[0]])} END" for i in turns[1]]
    return _least(_edit(f"i{state}", "4", "D"), *kept, *set_)


_FAR = "{'c': 1000000000, 'a': '', 'r': ''}"
_USER = _least("s2", *(_edit(f"s{i}", "3", "I", _INSERTED["user"]) for i in (0, 1, 3)))
_ASSISTANT = _least("s3", _edit("i2", "3", "I", _INSERTED["assistant"]))

ORACLE["op13_structure_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM said WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, substring(role, 1, 64), substring(text, 1, 64), sha256(length(role) || ':' || role || text)) AS n FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, n, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair FROM ordered),
faults AS (SELECT *, NOT blank AND NOT again AS ok, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM judged),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND again) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM faults GROUP BY 1),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 'r': ''}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM convs
  UNION ALL
  SELECT conv_id, n, {_step(0)}, {_step(1)}, {_step(2)}, {_step(3)} FROM (
    SELECT *, {_ASSISTANT} AS i3 FROM (
      SELECT w.conv_id, f.n, role, text, ok, more, s3, s0 AS i0, s1 AS i1, {_USER} AS i2
      FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1))),
ended AS (
  SELECT conv_id, {_least("s0", _ASSISTANT)} AS best FROM (
    SELECT w.conv_id, s0, s3, {_USER} AS i2 FROM walk w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.n = coalesce(c.n, 0)))
SELECT e.conv_id, {', '.join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
  CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substring(best.r, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
