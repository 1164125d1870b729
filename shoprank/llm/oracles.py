"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}
U, L = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op1_ngram_join"]=f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(list_slice(w, k, k + 4), ' ') FOR k IN range(1, len(w) - 3)]) END AS s FROM worded),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, least(z.doc_id, coalesce(min(r.b), z.doc_id)) AS component_id
FROM sizes z LEFT JOIN reach r ON r.a = z.doc_id GROUP BY z.doc_id, z.n"""

SQL["op9_contamination"]=f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS g FROM bs, range(1, 100000) r(k) WHERE k <= len(w) - m + 1),
spots AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS k, w FROM dw, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m),
spotted AS (SELECT s.doc_id, s.k, s.m, x.item FROM spots s JOIN wins x ON x.m = s.m AND x.g = array_to_string(list_slice(s.w, s.k, s.k + s.m - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM spotted) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM spotted WHERE item IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.list, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)"""

SQL["op10_topk"]="""
WITH v AS (SELECT DISTINCT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""


# One node a row: level 0 holds the leaves, a tree with more than one node gets another level. `ups` has what stands left and right
# of a node in its run. The checksum goes through the bits of the decimal id.
SQL["op11_merkle"]=f"""
WITH RECURSIVE plain AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, text,
  concat('', {', '.join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || {f}, '-')" for f in ('doc_id', 'source', 'lang', 'n_chars'))}) AS head FROM documents),
ided AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(text) || ':' || translate(text, '{U}', '{L}'), '-')) AS changed,
  xor(list_reduce([4294967295] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 3 = 0 AS tampered FROM plain),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM ided),
nodes(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT tree, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY ALL),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM tops
  UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY ALL),
root AS (SELECT h AS root FROM uppers WHERE n = 1),
every AS (SELECT tree, lvl, pos, n, h FROM nodes UNION ALL SELECT NULL, lvl, pos, n, h FROM uppers),
ups AS (SELECT tree, lvl, pos, n, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM every
  WINDOW r AS (PARTITION BY tree, lvl, pos // 8 ORDER BY pos)),
walk(doc_id, own, tree, lvl, pos, proof, h) AS (SELECT doc_id, tree || ' ' || pos, tree, 0, pos, '', CASE WHEN tampered THEN changed ELSE leaf END FROM leaves
  UNION ALL SELECT w.doc_id, w.own, w.tree, w.lvl + 1, w.pos // 8, w.proof || u.l || u.r, sha256(u.l || w.h || u.r)
  FROM walk w JOIN ups u ON u.tree = w.tree AND u.lvl = w.lvl AND u.pos = w.pos WHERE u.n > 1),
inner_ends AS (SELECT w.*, t.pos AS place, t.h AS subroot FROM walk w JOIN (SELECT tree, max(lvl) AS lvl FROM nodes GROUP BY 1) e USING (tree, lvl) JOIN tops t USING (tree)),
climb(own, lvl, pos, proof, h) AS (SELECT own, 0, place, proof, h FROM inner_ends
  UNION ALL SELECT w.own, w.lvl + 1, w.pos // 8, w.proof || u.l || u.r, sha256(u.l || w.h || u.r)
  FROM climb w JOIN ups u ON u.tree IS NULL AND u.lvl = w.lvl AND u.pos = w.pos WHERE u.n > 1),
ends AS (SELECT c.* FROM climb c WHERE c.lvl = (SELECT max(lvl) FROM uppers))
SELECT l.doc_id, l.leaf, i.subroot, root.root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = root.root AS verified
FROM leaves l JOIN inner_ends i ON i.own = l.tree || ' ' || l.pos JOIN ends e ON e.own = i.own, root"""

SQL["op12_infill"]="""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (SELECT *, len(t) AS n, [CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM cut),
ranked AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parted"""
