"""DuckDB forms of the two operators on conversations."""

from __future__ import annotations

#: 256 entries of the reflected CRC-32 table, and the CRC of a text of ASCII characters.
CRC_TABLE = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


PREFIX_TRIE = rf"""
WITH {CRC_TABLE},
raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
item AS (SELECT c, turn, role, strlen(text) AS n, left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32) AS k FROM raw),
own AS (SELECT c, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, role, k) AS s FROM item GROUP BY c),
h AS (SELECT c, s, c - c % 5 AS base, ({crc('c::VARCHAR')} % 9)::BIGINT AS h FROM own, tab),
built AS (SELECT h.c, CASE WHEN h.c = base THEN h.s ELSE list_concat(coalesce(o.s[1:h.h], []), h.s[h.h + 1:]) END AS s FROM h LEFT JOIN own o ON o.c = h.base),
path AS (SELECT c, len(s) AS length, s, unnest(range(0, len(s) + 1)) AS depth FROM built),
pre AS (SELECT c, length, depth, array_to_string(list_transform(s[1:depth], lambda x: x.k), '') AS key, CASE WHEN depth > 0 THEN s[depth].n ELSE 0 END AS n FROM path),
node AS (SELECT key, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = length) AS ends FROM pre GROUP BY key),
kid AS (SELECT left(key, 32 * (depth - 1)::BIGINT) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid USING (key)),
up AS (SELECT left(key, 32 * anc::BIGINT) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS anc FROM full_node) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN up USING (key) LEFT JOIN node p ON f.depth > 0 AND p.key = left(f.key, 32 * (f.depth - 1)::BIGINT)"""


def _more(state: str, price: str, letter: str, turn: str | None) -> str:
    text = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
    return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', 't': {text}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


_NEVER = "{'c': 1000000::BIGINT, 'a': '~', 't': []::VARCHAR[]}"
_FIRST = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"


def _where(test: str, state: str) -> str:
    return f"CASE WHEN {test} THEN {state} ELSE {_NEVER} END"


_DROPPED = {q: _more(f"w.{q}", "4", "D", None) for q in ("o", "s", "u", "a")}
_BEFORE_USER = _least("w.o", "w.s", "w.a")

#: One row a conversation and turn: o, s, u, a are the least (cost, edits, repaired turns) that end in nothing, a system, a user, an assistant turn.
REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
coded AS (SELECT raw.*, {crc('id')} % 20 AS code FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM coded),
line AS MATERIALIZED (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dam),
row_f AS MATERIALIZED (SELECT conv_id, i, role, left(role, 1) AS r, turn, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, role || ':' || text AS whole, text,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM line),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
        count_if(prev || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM row_f GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, {_FIRST} AS o, {_NEVER} AS s, {{'c': 3::BIGINT, 'a': 'I', 't': ['user:']}} AS u, {_NEVER} AS a FROM stat
  UNION ALL
  SELECT conv_id, i, o, s, {_least('u', _more('list_sort([o, s, a])[1]', '3', 'I', "'user:'"))} AS u, {_least('a', _more('u', '3', 'I', "'assistant:'"))} AS a FROM (
    SELECT w.conv_id, f.i, {_DROPPED['o']} AS o, {_least(_DROPPED['s'], _where("f.fault IN (0, 3) AND f.r = 's'", _more('w.o', 'f.fault', 'K', 'f.whole')))} AS s,
      {_least(_DROPPED['u'], _where("f.fault IN (0, 3) AND f.r = 'u'", _more(_BEFORE_USER, 'f.fault', 'K', 'f.whole')), _where('f.fault IN (0, 3)', _more(_BEFORE_USER, '3 + f.fault', 'R', "'user:' || f.text")))} AS u,
      {_least(_DROPPED['a'], _where("f.fault IN (0, 3) AND f.r = 'a'", _more('w.u', 'f.fault', 'K', 'f.whole')), _where('f.fault IN (0, 3)', _more('w.u', '3 + f.fault', 'R', "'assistant:' || f.text")))} AS a
    FROM walk w JOIN row_f f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
best AS (SELECT walk.conv_id, stat.*, {_least('o', 'a')} AS b FROM walk JOIN stat ON stat.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = stat.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
