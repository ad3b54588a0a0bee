"""DuckDB counterparts of the queries that SQL can express, over whole tables.

Without one: the URL model (5), HTML extraction (6), XXH64 fingerprints (7) and the random field
(10); they are tested against brute force.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
windows AS (SELECT rid, p, x, n, CASE WHEN p + 34 <= n THEN string_agg(x, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS s FROM words),
repeated AS (SELECT rid, p, x, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 THEN 1 ELSE 0 END AS r FROM windows),
covered AS (SELECT rid, p, x, sum(r) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM repeated),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS t, count(*) FILTER (WHERE gone) AS n FROM covered GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

OP2 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP3 = rf"""
WITH RECURSIVE l AS (
  SELECT mid, conv_id, turn, i, line, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    translate(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[\x00-\x20]+', ' ', 'g')), '{UPPER}', '{LOWER}') AS norm
  FROM (SELECT row_number() OVER () AS mid, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM conversations)),
opened AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY mid ORDER BY i) THEN 0 ELSE 1 END AS o FROM l),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY mid ORDER BY i) AS run FROM opened),
runs AS (SELECT conv_id, turn, level, trim(regexp_replace(string_agg(norm, ' ' ORDER BY i), ' +', ' ', 'g')) AS t FROM numbered GROUP BY mid, conv_id, turn, level, run),
passages AS (
  SELECT DISTINCT conv_id, turn, level, norm FROM (
    SELECT conv_id, turn, level, norm FROM l UNION ALL
    SELECT conv_id, turn, level, trim(unnest(string_split(regexp_replace(t, '([.!?…。！？]) +', '\1' || chr(1), 'g'), chr(1)))) FROM runs)
  WHERE norm <> '' AND turn IS NOT NULL),
origin AS (SELECT conv_id, norm, min(turn) AS origin FROM passages WHERE level = 0 GROUP BY ALL),
found AS (SELECT p.conv_id, p.turn, p.level, o.origin FROM passages p JOIN origin o ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.norm = o.norm WHERE p.level > 0 AND o.origin < p.turn),
parent AS (SELECT conv_id, turn, origin AS reply_to FROM (SELECT conv_id, turn, origin, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, origin DESC) AS k FROM found WHERE level = 1 GROUP BY conv_id, turn, origin) WHERE k = 1),
turns AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn IS NOT NULL),
tree AS (
  SELECT t.conv_id, t.turn, NULL::BIGINT AS reply_to, t.turn AS thread, [t.turn] AS way FROM turns t LEFT JOIN parent p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.turn = p.turn WHERE p.turn IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, p.reply_to, t.thread, list_append(t.way, p.turn) FROM parent p JOIN tree t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.turn = p.reply_to),
placed AS (SELECT conv_id, turn, reply_to, thread, row_number() OVER (PARTITION BY conv_id, thread ORDER BY way) - 1 AS position FROM tree),
shape AS (SELECT mid, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '')) AS body, count(*) FILTER (WHERE level > 0 AND norm <> '') AS n_quoted, max(level)::BIGINT AS quote_depth FROM l GROUP BY mid),
counted AS (SELECT conv_id, turn, count(*) AS n_found FROM found GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, s.body, s.n_quoted, s.quote_depth, coalesce(k.n_found, 0)::BIGINT AS n_found, t.reply_to, t.thread, t.position::BIGINT AS position
FROM (SELECT row_number() OVER () AS mid, * FROM conversations) c JOIN shape s USING (mid)
LEFT JOIN placed t ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.turn = t.turn LEFT JOIN counted k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND c.turn = k.turn
"""

OP4 = f"""
WITH b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS size FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
ahead AS (SELECT rid, p, n, list(x) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS f FROM words),
hits AS (SELECT a.rid, a.p, i.size, i.item_id FROM (SELECT rid, p, size, array_to_string(f[1 : size], ' ') AS s FROM ahead JOIN sizes ON p + size - 1 <= n) a JOIN items i ON i.s = a.s AND i.size = a.size),
spots AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (rid) LEFT JOIN ids USING (rid)
"""


def _apportioned(name: str, parties: str, votes: str, seats: str, within: str, party: str) -> str:
    """CTEs that end in ``name``: the columns of ``parties`` and ``quota``; as mixing.apportioned."""
    return f"""
{name}_a AS (SELECT *, {seats} AS _seats, sum({votes}) OVER (PARTITION BY {within}) AS _total FROM {parties}),
{name}_b AS (SELECT *, floor(CASE WHEN _total > 0 THEN _seats * {votes} / _total ELSE 0 END + 0.5)::BIGINT AS _near FROM {name}_a),
{name}_c AS (SELECT *, _seats - sum(_near) OVER (PARTITION BY {within})::BIGINT AS _off FROM {name}_b),
{name}_d AS (SELECT {within} AS _w, {party} AS _p, _off, {votes} / (2 * (_near + step) + 1) AS quotient, abs(step) AS far FROM (SELECT *, unnest(CASE WHEN _off > 0 THEN range(0, _off) WHEN _off < 0 AND _near > 0 THEN range(-1, greatest(_off, -_near) - 1, -1) ELSE [] END) AS step FROM {name}_c)),
{name}_e AS (SELECT *, row_number() OVER (PARTITION BY _w ORDER BY CASE WHEN _off > 0 THEN -quotient ELSE quotient END, _p NULLS LAST, far) AS place FROM {name}_d),
{name}_f AS (SELECT _w, _p, sum(sign(_off))::BIGINT AS moved FROM {name}_e WHERE place <= abs(_off) GROUP BY ALL),
{name} AS (SELECT c.* EXCLUDE (_seats, _total, _near, _off), c._near + coalesce(f.moved, 0) AS quota FROM {name}_c c LEFT JOIN {name}_f f ON c.{within} IS NOT DISTINCT FROM f._w AND c.{party} IS NOT DISTINCT FROM f._p)"""


OP8 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s0 AS (SELECT source, count(*) AS n_rows, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM s1),
lv AS (SELECT own_level AS level FROM s2 WHERE own_level * weight < cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
s3 AS (SELECT source, n_rows, source_size, 1 AS everything, CASE WHEN level IS NULL OR level * weight >= cap THEN cap::DOUBLE ELSE level * weight END AS target FROM s2 LEFT JOIN lv ON true),
{_apportioned("q", "s3", "target", "floor(sum(target) OVER () / 16 + 0.5)::BIGINT", "everything", "source")},
dealt AS (SELECT d.doc_id, d.source, d.size, d.place, q.source_size, q.target, q.quota AS source_quota, d.place % greatest(1, ceil(q.n_rows / 2000)::BIGINT) AS shard FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
sh AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, min(source_quota) AS source_quota FROM dealt GROUP BY ALL),
{_apportioned("r", "sh", "shard_size", "source_quota", "source", "shard")},
filled AS (SELECT dealt.*, r.shard_size, least(r.quota * 16, 3 * r.shard_size) AS due, coalesce(sum(size) OVER (PARTITION BY dealt.source, dealt.shard ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt JOIN r ON dealt.source IS NOT DISTINCT FROM r.source AND dealt.shard = r.shard),
passed AS (SELECT *, CASE WHEN shard_size > 0 THEN due // shard_size ELSE 0 END AS passes FROM filled)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, due - passes * shard_size - before)))::BIGINT AS taken FROM passed
"""

OP9 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT rid, h, unnest(range(length(h) // 2)) AS i, length(h) // 2 AS n FROM d),
prefixes AS (SELECT rid, i, substring(h, (2 * i + 1)::BIGINT, 2) AS x, CASE WHEN i + 100 <= n THEN md5(substring(h, (2 * i + 1)::BIGINT, 200)) END AS s FROM bytes),
later AS (SELECT rid, i, x, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY rid, i) > 1 THEN 1 ELSE 0 END AS r FROM prefixes),
covered AS (SELECT rid, i, x, sum(r) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone FROM later),
edges AS (SELECT rid, i, x, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS opens FROM covered),
kept AS (SELECT rid, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS t, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans FROM edges GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1, "op2_exact_dedup": OP2, "op3_chat_threads": OP3, "op4_decontamination": OP4, "op8_source_mixing": OP8, "op9_suffix_array_dedup": OP9}
