"""The same results in DuckDB's SQL, over whole tables."""

from jetlake.llm import url_filters

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"

# Distinct shingles of {table}.{id}: five words, or the whole sequence where there are fewer.
SHINGLES = """
SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
FROM (SELECT {id} AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '%s', '%s'), '%s'),
  lambda x: x <> '') AS w FROM {table})
""" % (UPPER, LOWER, SPACE)

OP1 = f"""
WITH RECURSIVE sets AS MATERIALIZED ({SHINGLES.format(id='doc_id', table='documents')}),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.x = b.x AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.id AS doc_id, len(s.s) AS n_shingles, m.c AS component_id, s.id = m.c AS kept
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  sha256(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS sha FROM documents),
g AS (SELECT doc_id, sha, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY sha) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
"""

PROBE = r"\### Assistant: </turn> ok"
ESCAPED = r"regexp_replace({}, '([\\<>])', '\\\1', 'g')"

OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')) p)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length({ESCAPED.format('role')}) + length({ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8 = f"""
WITH d AS ({SHINGLES.format(id='doc_id', table='documents')}), i AS ({SHINGLES.format(id='item_id', table='benchmark')}),
dx AS (SELECT id, unnest(s) AS x FROM d), ix AS (SELECT id, len(s) AS n, unnest(s) AS x FROM i)
SELECT dx.id AS doc_id, ix.id AS item_id, ix.n AS item_shingles, count(*) AS common
FROM dx JOIN ix ON dx.x = ix.x GROUP BY dx.id, ix.id, ix.n HAVING 100 * count(*) >= 80 * ix.n
"""

# One round after another: centroids c{k}, then the nearest one of each vector, then their floored means.
_ROUNDS = "".join(f"""
a{k} AS MATERIALIZED (SELECT q.r, q.vec_id, q.v, c.c, list_sum(list_transform(range(1, 65),
    lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))::BIGINT AS d FROM q CROSS JOIN c{k} c
  QUALIFY row_number() OVER (PARTITION BY q.r ORDER BY d, c.c) = 1),""" + (f"""
m{k} AS (SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.c = c.c),"""
    if k < 5 else "") for k in range(6))

OP11 = f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
  SELECT sha256('2:' || vec_id) AS h, v FROM q WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)),{_ROUNDS}
s AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a5 GROUP BY c)
SELECT a5.vec_id, a5.c::INT AS cluster, a5.d AS distance, s.cluster_inertia,
  (SELECT sum(d)::BIGINT FROM a5) AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN s ON s.c = a5.c JOIN c5 ON c5.c = a5.c
"""

FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
# Unsigned crc32 of the decimal doc_id: eight shifts per byte.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
# Levels of a forest of 16-ary trees over {leaves} (g, pos, node); a group rests at its single node.
FOREST = """(
  SELECT g, 0 AS level, pos, node FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, level, pos // 16)"""
# Climbs from {start} (id, g, pos, node, proof) with the siblings that the forest holds.
CLIMB = """(
  SELECT id, g, 0 AS level, pos, node, proof FROM {start}
  UNION ALL
  SELECT p.id, p.g, p.level + 1, p.pos // 16, sha256(coalesce(string_agg(CASE WHEN t.pos = p.pos THEN p.node ELSE t.node END, '' ORDER BY t.pos), '')),
    p.proof || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> p.pos), '')
  FROM {name} p JOIN {tree} t ON t.g = p.g AND t.level = p.level AND t.pos // 16 = p.pos // 16
  WHERE p.level < (SELECT max(level) FROM {tree} x WHERE x.g = p.g)
  GROUP BY p.id, p.g, p.level, p.pos, p.node, p.proof)"""
TOP = "(SELECT g, max(level) AS level FROM {0} GROUP BY g)"

OP12 = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, source, {LEAF.format(text=FIELD.format('text'))} AS leaf,
    CASE WHEN {CRC} % 5 = 0 THEN {LEAF.format(text=FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} END AS copy
  FROM documents),
n AS MATERIALIZED (SELECT id, doc_id, leaf, coalesce(copy, leaf) AS copy,
  CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
nodes AS (SELECT g, pos, leaf AS node FROM n),
lower AS {FOREST.format(leaves='nodes', name='lower')},
subroots AS MATERIALIZED (SELECT w.g, w.node, row_number() OVER (ORDER BY encode(w.g)) - 1 AS pos
  FROM lower w JOIN {TOP.format('lower')} m ON m.g = w.g AND m.level = w.level),
names AS (SELECT 'r' AS g, pos, node FROM subroots),
upper AS {FOREST.format(leaves='names', name='upper')},
root AS (SELECT node FROM upper ORDER BY level DESC LIMIT 1),
start AS (SELECT id, g, pos, copy AS node, '' AS proof FROM n),
up AS {CLIMB.format(start='start', name='up', tree='lower')},
mid AS (SELECT u.id, 'r' AS g, s.pos, u.node, u.proof FROM up u JOIN {TOP.format('lower')} m ON m.g = u.g AND m.level = u.level
  JOIN subroots s ON s.g = u.g),
fin AS {CLIMB.format(start='mid', name='fin', tree='upper')}
SELECT n.doc_id, n.leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root,
  f.node = r.node AS verified
FROM n JOIN subroots s ON s.g = n.g JOIN fin f ON f.id = n.id AND f.level = (SELECT max(level) FROM upper) CROSS JOIN root r
"""

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
          ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in _RULES)


def _found(terms):
    edge = "(?:^|[^a-z0-9]|$)"
    tests = ", ".join(f"CASE WHEN regexp_matches(u, '{edge}{t}{edge}') THEN '{t}' END" for t in sorted(terms))
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


OP13 = f"""
WITH p AS (SELECT row_number() OVER () AS id, page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
    regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '%[0-9a-f][0-9a-f]', ' ', 'g') AS u FROM pages),
rules(verdict, h, s) AS (VALUES {_RULE_ROWS}),
best AS (SELECT p.id, arg_max(struct_pack(rule := h || s, verdict := verdict), length(h) + length(s)) AS b
  FROM p JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, s) GROUP BY p.id),
t AS (SELECT p.*, {_found(url_filters.STRICT)} AS strict_terms, {_found(url_filters.SOFT)} AS soft_terms FROM p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict,
  CASE WHEN len(strict_terms) > 0 OR len(soft_terms) >= 2 THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms
FROM t LEFT JOIN best ON best.id = t.id
"""

ORACLES = {"op1_minhash_dedup": OP1, "op4_exact_dedup": OP4, "op7_chat_format": OP7, "op8_decontamination": OP8,
           "op11_centroid_clustering": OP11, "op12_merkle_manifest": OP12, "op13_url_filters": OP13}
