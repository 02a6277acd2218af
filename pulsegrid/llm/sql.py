"""DuckDB SQL of the operators that SQL can express."""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
places AS (SELECT n, doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS p FROM split),
windows AS (SELECT n, doc_id, p, array_to_string(words[p : p + 12], ' ') AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
late AS (SELECT n, unnest(range(p, p + 13)) AS k FROM windows JOIN firsts USING (w) WHERE doc_id > least),
cut AS (SELECT n, list(DISTINCT k) AS ks FROM late GROUP BY n),
done AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(ks), 0) AS n_removed,
         [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(coalesce(ks, []), k)] AS kept
  FROM split LEFT JOIN cut USING (n))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM done
"""

FILTER_AUDIT = r"""
WITH rows AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM rows GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT r.n, r.part,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
          100 * length(regexp_replace(r.t, '[^A-Z]', '', 'g')) > 5 * length(r.t),
          regexp_matches(r.t, '[#$%&*|]'), coalesce(r.doc_id > f.least, false)] AS fails,
         coalesce(m.good, 0) = 1 AS good, coalesce(m.toxic, 0) = 1 AS toxic
  FROM rows r JOIN firsts f ON r.t = f.t LEFT JOIN marks m ON r.doc_id = m.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
sets AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY part, fails),
walks AS (
  SELECT s.*, o.filter_order,
         [s.fails[instr('ABCDE', substr(o.filter_order, k, 1))] FOR k IN [1, 2, 3, 4, 5]] AS failed
  FROM sets s CROSS JOIN orders o),
placed AS (SELECT *, coalesce(list_position(failed, true), 6) AS falls, len(list_filter(failed, lambda x: x)) AS many FROM walks),
steps AS (SELECT unnest([1, 2, 3, 4, 5]) AS step),
counts AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter,
         sum(CASE WHEN falls > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN falls = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN falls < step AND failed[step] THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed[step] AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN falls = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN falls = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM placed CROSS JOIN steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM counts
"""

_FIELD = "coalesce(strlen(({0})::VARCHAR)::VARCHAR || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{count}", "text")) + ")"
# CRC-32 by bits; the value before the last inversion.
_CRC = """xor(list_reduce(
  list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda u, i: xor(u >> 1, 3988292384 * (u & 1))),
  4294967295::BIGINT), 4294967295)"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF.format(count="n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(count="n_chars + 1")} END AS changed
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS total
  FROM leaves),
nodes(tree, level, pos, total, h) AS (
  SELECT tree, 0, pos, total, leaf FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 2, any_value((total + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE total > 1 GROUP BY tree, pos // 2),
subroots AS (SELECT tree, h AS subroot, level AS depth FROM nodes WHERE total = 1),
crown(level, pos, total, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 2, any_value((total + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM crown WHERE total > 1 GROUP BY pos // 2),
ways(tree, pos, leaf, changed, doc_id, level, place, proof, folded) AS (
  SELECT tree, pos, leaf, changed, doc_id, 0, pos, '', coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT w.tree, w.pos, w.leaf, w.changed, w.doc_id, w.level + 1, w.place // 2, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.place % 2 = 1 THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END)
  FROM ways w JOIN subroots t ON t.tree = w.tree AND w.level < t.depth
  LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.place, 1)),
done AS (SELECT w.*, t.subroot FROM ways w JOIN subroots t ON t.tree = w.tree AND w.level = t.depth),
up(tree, pos, leaf, doc_id, subroot, level, place, proof, folded) AS (
  SELECT tree, pos, leaf, doc_id, subroot, 0, tree, proof, folded FROM done
  UNION ALL
  SELECT w.tree, w.pos, w.leaf, w.doc_id, w.subroot, w.level + 1, w.place // 2, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.place % 2 = 1 THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END)
  FROM up w JOIN (SELECT max(level) AS depth FROM crown) c ON w.level < c.depth
  LEFT JOIN crown s ON s.level = w.level AND s.pos = xor(w.place, 1)),
root AS (SELECT h AS root, level AS depth FROM crown WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM up JOIN root ON up.level = root.depth
"""
