"""DuckDB SQL for the numbered queries that SQL can express, written without the operators' shortcuts."""

TOPK = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.uid, q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

# every quotient of every party is listed and ranked here
MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][1 + (r - 1) % 3] AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (
  SELECT *, CASE WHEN cap / weight <= level THEN CAST(cap AS DOUBLE)
    ELSE max(CASE WHEN cap / weight > level THEN level END) OVER () * weight END AS target FROM l),
sq AS (
  SELECT r, k FROM t, unnest(range(0, 3 * CAST(ceil(source_size / 8) AS BIGINT))) AS u(k)
  QUALIFY row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r, k) <= (SELECT any_value(total) // 8 FROM t)),
sn AS (
  SELECT t.*, coalesce(c.n, 0) AS quota, greatest(1, CAST(ceil(source_size / greatest(65536, ceil(4 * sqrt(source_size)))) AS BIGINT)) AS shards
  FROM t LEFT JOIN (SELECT r, count(*) AS n FROM sq GROUP BY r) c USING (r)),
p AS (
  SELECT d.*, sn.* EXCLUDE (source), CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS h,
  FROM d JOIN sn ON d.source IS NOT DISTINCT FROM sn.source),
ps AS (SELECT *, h % shards AS shard FROM p),
z AS (SELECT r, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS seats FROM ps GROUP BY r, shard),
zk AS (
  SELECT r, shard, k FROM z, unnest(range(0, 3 * CAST(ceil(shard_size / 8) AS BIGINT))) AS u(k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY shard_size / (2 * k + 1) DESC, shard, k) <= seats),
zq AS (
  SELECT z.r, z.shard, shard_size, coalesce(c.n, 0) AS q, greatest(1, CAST(ceil(shard_size / 8) AS BIGINT)) AS nb
  FROM z LEFT JOIN (SELECT r, shard, count(*) AS n FROM zk GROUP BY r, shard) c USING (r, shard)),
e AS (
  SELECT ps.*, q // nb AS base, q % nb AS extra, nb,
    CAST('0x' || substr(md5('17:' || r || ':' || shard), 1, 15) AS BIGINT) % nb AS phase,
    CAST(sum(size) OVER (PARTITION BY r, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM ps JOIN zq USING (r, shard)),
g AS (
  SELECT *, [base * x + 8 * ((x // 8 * extra + phase) // nb)
    + ((((x // 8) + 1) * extra + phase) // nb - (x // 8 * extra + phase) // nb) * (x % 8) FOR x IN [stop - size, stop]] AS upto FROM e)
SELECT doc_id, size, source_size, target, CAST(upto[2] - upto[1] AS BIGINT) AS taken FROM g
"""

URL_FILTER = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT h || pre FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h) DESC, length(pre) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) ORDER BY length(h) DESC, length(pre) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

PREFERENCES = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (
  SELECT t.*, a.last, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN a USING (conv_id) WHERE turn <= a.last),
x AS (
  SELECT a.conv_id, l.text AS yes, CASE WHEN a.first < a.last THEN f.text ELSE '' END AS no
  FROM a JOIN t l ON l.conv_id = a.conv_id AND l.turn = a.last JOIN t f ON f.conv_id = a.conv_id AND f.turn = a.first),
p AS (
  SELECT conv_id, count(*) FILTER (turn < last) AS n, coalesce(string_agg(shown, '' ORDER BY turn) FILTER (turn < last), '') AS prompt,
    string_agg(shown, '' ORDER BY turn) AS everything FROM r GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN yes = no THEN n + 1 ELSE n END AS INTEGER) AS prompt_turns,
  CASE WHEN yes = no THEN everything ELSE prompt END AS prompt,
  CASE WHEN yes = no THEN '' ELSE '<|assistant|>' || chr(10) || yes || '<|end|>' || chr(10) END AS chosen,
  CASE WHEN yes = no THEN '' ELSE '<|assistant|>' || chr(10) || no || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN yes = no THEN '' ELSE '14:' || CAST(14 + length(yes) + 7 AS VARCHAR) END AS chosen_spans,
  CASE WHEN yes = no THEN '' ELSE '14:' || CAST(14 + length(no) + 7 AS VARCHAR) END AS rejected_spans
FROM p JOIN x USING (conv_id)
"""

# the table of the checksum is worked out bit by bit
CRC = """
crc_table AS (
  SELECT list(list_reduce([CAST(b AS BIGINT)] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) ORDER BY b) AS crc_steps FROM range(256) AS u(b))"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string; crc_steps is in scope."""
    codes = f"[CAST(4294967295 AS BIGINT)] || list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(crc_steps[1 + xor(c, b) % 256], c // 256)), CAST(4294967295 AS BIGINT))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", n_chars, "text")) + ")"


def _levels(base: str) -> str:
    """Nodes (g, k, i, n, h) of trees: number i of the n nodes of level k of group g."""
    return f"""{base}
  UNION ALL
  SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM level WHERE n > 1 GROUP BY g, k, n, i // 2"""


def _path(nodes: str) -> str:
    """Per leaf i of group g: its siblings with their sides, level by level."""
    return f"""SELECT l.g, l.i, list(CASE WHEN s.h IS NULL THEN '' WHEN a.i % 2 = 1 THEN '<' || s.h ELSE '>' || s.h END ORDER BY a.k) FILTER (a.k IS NOT NULL) AS path
  FROM {nodes} l LEFT JOIN {nodes} a ON a.g = l.g AND a.n > 1 AND a.i = l.i // CAST(2 ** a.k AS BIGINT)
  LEFT JOIN {nodes} s ON s.g = a.g AND s.k = a.k AND s.i = a.i + 1 - 2 * (a.i % 2) WHERE l.k = 0 GROUP BY l.g, l.i"""


MERKLE = f"""
WITH RECURSIVE {CRC},
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("CAST(n_chars AS VARCHAR)")} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("CAST(n_chars + 1 AS VARCHAR)")} ELSE {_leaf("CAST(n_chars AS VARCHAR)")} END AS told FROM documents, crc_table),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (WITH RECURSIVE level(g, k, i, n, h) AS ({_levels("SELECT g, 0, i, n, leaf FROM o")}) SELECT * FROM level),
tops AS (SELECT g AS of, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (WITH RECURSIVE level(g, k, i, n, h) AS ({_levels("SELECT '', 0, i, n, h FROM tops")}) SELECT * FROM level),
low_path AS ({_path("low")}),
high_path AS ({_path("high")}),
w AS (
  SELECT o.doc_id, leaf, told, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(a.path, []) || coalesce(b.path, []) AS path
  FROM o JOIN low_path a ON a.g = o.g AND a.i = o.i JOIN tops t ON t.of = o.g JOIN high_path b ON b.i = t.i),
x AS (
  SELECT *, list_reduce([told] || path, lambda h, p: sha256(CASE WHEN p = '' THEN h WHEN p[1] = '<' THEN substr(p, 2) || h ELSE h || substr(p, 2) END)) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: substr(p, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM x
"""

# every way is followed row by row; of those to one state the cheapest stays, then the least string
REPAIR = rf"""
WITH RECURSIVE {CRC},
r AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc_table),
m AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM m),
c AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd, count(*) OVER (PARTITION BY g) AS n FROM o),
s AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM c GROUP BY g),
ins(a, b, letters, price, lines) AS (VALUES (0, 0, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, '', 0, ''), (1, 2, 'I', 5, chr(10) || 'user:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, '', 0, ''), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 3, '', 0, ''), (3, 2, 'I', 5, chr(10) || 'user:')),
ed(b, letter, price, initial, z, role) AS (VALUES (0, 'D', 2, '', 0, ''), (1, 'D', 2, '', 1, ''), (2, 'D', 2, '', 2, ''), (3, 'D', 2, '', 3, ''), (0, 'R', 1, '', 2, 'user'), (1, 'R', 1, '', 2, 'user'), (2, 'R', 1, '', 3, 'assistant'), (3, 'R', 1, '', 2, 'user'),
  (0, 'K', 0, 's', 1, ''), (0, 'K', 0, 'u', 2, ''), (1, 'K', 0, 'u', 2, ''), (2, 'K', 0, 'a', 3, ''), (3, 'K', 0, 'u', 2, '')),
way(g, i, z, w) AS (
  SELECT g, CAST(1 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM s
  UNION ALL
  SELECT way.g, way.i + 1, ed.z, min({{
      'cost': CAST(way.w.cost + ins.price + ed.price + CASE WHEN ed.letter <> 'D' AND c.fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT), 'audit': way.w.audit || ins.letters || ed.letter,
      'lines': way.w.lines || ins.lines || CASE ed.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || c.role || ':' || c.text ELSE chr(10) || ed.role || ':' || c.text END}})
  FROM way JOIN c ON c.g = way.g AND c.i = way.i JOIN ins ON ins.a = way.z JOIN ed ON ed.b = ins.b AND (ed.initial = '' OR ed.initial = c.initial) AND (ed.letter = 'D' OR c.fault NOT IN ('blank', 'duplicate'))
  GROUP BY way.g, way.i + 1, ed.z),
z AS (
  SELECT way.g, min({{'cost': way.w.cost + CASE way.z WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': way.w.audit || CASE way.z WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': way.w.lines || CASE way.z WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS w
  FROM way JOIN (SELECT g, count(*) AS n FROM c GROUP BY g) q ON q.g = way.g AND way.i = q.n + 1 GROUP BY way.g)
SELECT k.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  coalesce(z.w.cost, 0) AS cost, coalesce(z.w.audit, '') AS audit, sha256(coalesce(substr(z.w.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM r) k LEFT JOIN s ON s.g = k.g LEFT JOIN z ON z.g = k.g
"""
