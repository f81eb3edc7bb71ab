"""SQL of the queries that SQL can express and that whole tables allow.

Near-duplicates follow from their rule alone: sets of shingles, pairs that share enough of them, smallest reachable id. The
manifest is a recursion over levels, repairs of conversations one over rows, with the least cost and audit of each state.
The others are learned, keyed, coded, packed or approximate; tests compare them with brute force, round trips, libraries
or planted cases.
"""

from __future__ import annotations

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM b JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT DISTINCT u AS doc_id, u AS root FROM both_ways UNION SELECT v, root FROM r JOIN both_ways ON u = doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""


# Unsigned crc32 by its table; `t` is the table and `{0}` the text, of ASCII characters.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ascii(({0})[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _leaf(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + "))"


def _tree(name: str, leaves: str) -> str:
    """All levels of trees: leaves (tree, i, node, n) and above them every three nodes, to the last one."""
    return f"{name} AS (SELECT tree, 0 AS l, i, node, n FROM {leaves} UNION ALL SELECT tree, l + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, l, i // 3)"


def _siblings(levels: str, leaves: str, key: str, base: int) -> str:
    """For each leaf and level the nodes before and after it in its run."""
    own = "x.i // (3 ^ y.l)::BIGINT"
    part = "coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i {0} {1}), '')"
    return f"SELECT {key} AS k, x.tree, {base} + y.l AS l, {part.format('<', own)} || '|' || {part.format('>', own)} AS s FROM {leaves} x JOIN {levels} y ON y.tree IS NOT DISTINCT FROM x.tree AND y.n > 1 AND y.i // 3 = ({own}) // 3 GROUP BY {key}, x.tree, y.l"


_FOLD = "list_reduce(list_prepend({0}, list(s ORDER BY l)), lambda own, s: sha256(split_part(s, '|', 1) || own || split_part(s, '|', 2)))"

MANIFEST = f"""WITH RECURSIVE c AS ({_CRC_TABLE}),
d AS (SELECT doc_id, source AS tree, {_leaf("text")} AS node, CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS changed FROM documents, c),
x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS k FROM d),
{_tree("lv", "x")},
sub AS (SELECT 0 AS tree, tree AS source, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
{_tree("up", "sub")},
p AS ({_siblings("lv", "x", "x.k", 0)} UNION ALL SELECT x.k, x.tree, q.l, q.s FROM x JOIN ({_siblings("up", "sub", "x.source", 1000)}) q ON q.k IS NOT DISTINCT FROM x.tree),
f AS (SELECT x.k, sha256(coalesce(string_agg(replace(s, '|', ''), '' ORDER BY l), '')) AS proof_sha256, CASE WHEN count(s) = 0 THEN any_value(coalesce(changed, node)) ELSE {_FOLD.format("any_value(coalesce(changed, node))")} END AS folded_root FROM x LEFT JOIN p ON p.k = x.k GROUP BY x.k)
SELECT doc_id, x.node AS leaf, sub.node AS subroot, up.node AS root, proof_sha256, folded_root, folded_root = up.node AS verified FROM x JOIN f USING (k) JOIN sub ON sub.source IS NOT DISTINCT FROM x.tree JOIN up ON up.n = 1"""

_KIND = _CRC.format("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))") + " % 20"
_STATES = "(VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user'))"

CONVERSATIONS = f"""WITH RECURSIVE c AS ({_CRC_TABLE}),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} AS kind FROM conversations, c),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS held FROM d),
s AS (SELECT *, left(role, 1) AS z, CASE WHEN held = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(held, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(z) OVER (PARTITION BY conv_id ORDER BY i) || z AS pair FROM r),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
nx AS (SELECT * FROM {_STATES} v(q, nxt, who)),
ins AS (SELECT q, 0 AS m, q AS p, '' AS letters, [] :: VARCHAR[] AS made FROM nx UNION ALL SELECT ins.q, m + 1, nxt, letters || 'I', list_append(made, who || ':') FROM ins JOIN nx ON nx.q = ins.p WHERE m < 3),
act AS (SELECT ins.q, ins.m, letters, made, p, v.letter, CASE v.letter WHEN 'D' THEN p ELSE nxt END AS nxt, who FROM ins JOIN nx ON nx.q = ins.p, (VALUES ('D'), ('K'), ('R')) v(letter)),
dp AS (SELECT conv_id, 0 :: BIGINT AS i, 0 AS q, {{'cost': 0 :: BIGINT, 'audit': '', 'rows': [] :: VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM d)
 UNION ALL SELECT dp.conv_id, s.i, CASE WHEN letter = 'K' AND z = 's' THEN 1 ELSE nxt END, min({{'cost': best.cost + 5 * m + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'audit': best.audit || letters || letter, 'rows': list_concat(best.rows, made, CASE letter WHEN 'D' THEN [] WHEN 'R' THEN [who || ':' || text] ELSE [role || ':' || text] END)}})
 FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1 JOIN act ON act.q = dp.q
 WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR z = left(who, 1) OR z = 's' AND p = 0) GROUP BY 1, 2, 3),
fin AS (SELECT dp.conv_id, min({{'cost': best.cost + 5 * m, 'audit': best.audit || letters, 'rows': list_concat(best.rows, made)}}) AS best FROM dp JOIN (SELECT conv_id, max(n) AS n FROM s GROUP BY 1) e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.n = dp.i JOIN ins ON ins.q = dp.q WHERE p IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM o.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": NEAR_DUPLICATES, "op11_manifest": MANIFEST, "op13_conversations": CONVERSATIONS}
