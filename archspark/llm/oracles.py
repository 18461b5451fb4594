"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingles(width: str) -> str:
    """List of the distinct runs of `width` words of the list w; of all words where there are fewer; empty for none."""
    return f"list_distinct(list_transform(range(1, greatest(len(w) - {width}, 0) + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')))"


OP6 = f"""
WITH item AS (
  SELECT item_id, least(5, len(w)) AS width, {_shingles('5')} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), item_shingle AS (SELECT item_id, width, len(s) AS n, unnest(s) AS x FROM item
), doc AS (SELECT doc_id, {_WORDS} AS w FROM documents
), doc_shingle AS (
  SELECT DISTINCT doc_id, width, unnest({_shingles('width')}) AS x FROM doc, (SELECT DISTINCT width FROM item) WHERE len(w) >= width
), shared AS (
  SELECT doc_id, item_id, n, count(*) AS shared FROM doc_shingle JOIN item_shingle USING (width, x) GROUP BY ALL
)
SELECT doc_id, item_id, n AS item_shingles, shared, shared / n AS containment FROM shared WHERE 100 * shared >= 75 * n
"""

OP8 = rf"""
WITH RECURSIVE bytes AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL
), crc_step AS (
  SELECT k, 0 AS i, CAST(4294967295 AS UBIGINT) AS c FROM bytes
  UNION ALL
  SELECT k, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, CAST(ascii(substr(k, i // 9 + 1, 1)) AS UBIGINT))
                        WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END
  FROM crc_step WHERE i < 9 * len(k)
), crc AS (SELECT k, xor(c, CAST(4294967295 AS UBIGINT)) AS crc32_of FROM crc_step WHERE i = 9 * len(k)
), doc AS (
  SELECT doc_id, row_number() OVER () AS r, list_append({_WORDS}, ' end') AS w,
         coalesce(crc32_of % 5 = 1, false) AS held_out
  FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS k FROM documents) d LEFT JOIN crc USING (k)
), token AS (
  SELECT doc_id, r, held_out, unnest(w) AS x, unnest(list_prepend(' start', w[:-2])) AS h FROM doc
), train AS (SELECT * FROM token WHERE NOT held_out
), uni AS (SELECT x, count(*) AS c FROM train GROUP BY x
), bi AS (SELECT h, x, count(*) AS c FROM train GROUP BY h, x
), hist AS (SELECT h, sum(c) AS ch FROM bi GROUP BY h
), size AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM uni
), nr AS (
  SELECT o, list_transform(range(1, 7), lambda r: coalesce(list_sum(list_transform(list_filter(l, lambda e: e.c = r), lambda e: e.n)), 0)) AS n FROM (
    SELECT o, list({{'c': c, 'n': n}}) AS l FROM (SELECT 1 AS o, c, count(*) AS n FROM uni GROUP BY c UNION ALL SELECT 2, c, count(*) FROM bi GROUP BY c) GROUP BY o)
), fitted AS (
  SELECT o, regr_slope(ln(y), ln(x)) AS slope FROM (SELECT o, unnest(n) AS y, unnest(range(1, 7)) AS x FROM nr) WHERE y > 0 GROUP BY o
), disc AS (
  SELECT o, n, CASE WHEN slope < -1 THEN list_transform(range(1, 6), lambda r: (pow(1 + 1 / r, slope + 1) - pow(6, slope + 1)) / (1 - pow(6, slope + 1)))
    ELSE list_transform(range(1, 6), lambda r: (r - CASE WHEN n[1] > 0 THEN least(0.9, n[1] / (n[1] + 2 * n[2])) ELSE 0.5 END) / r) END AS d FROM nr LEFT JOIN fitted USING (o)
), rest AS (
  SELECT list_sum(list_transform(range(1, 6), lambda r: (1 - d[r]) * r * n[r])) AS q FROM disc WHERE o = 1
), p1 AS (
  SELECT x, CASE WHEN c <= 5 THEN d[c] ELSE 1 END * c / CASE WHEN q > 0 THEN size.n ELSE size.n + 1 END AS p FROM uni, disc, rest, size WHERE o = 1
), unk AS (SELECT CASE WHEN q > 0 THEN q / n ELSE 1 / (n + 1) END AS p FROM rest, size
), back AS (
  SELECT h, ch, CASE WHEN q > 0 THEN q ELSE 1 END AS q, CASE WHEN q > 0 THEN ch ELSE ch + 1 END AS below, seen FROM (
    SELECT h, any_value(ch) AS ch, sum(CASE WHEN c <= 5 THEN (1 - d[c]) * c ELSE 0 END) AS q, sum(p) AS seen
    FROM bi JOIN hist USING (h) JOIN p1 USING (x), disc WHERE o = 2 GROUP BY h)
), scored AS (
  SELECT doc_id, r, held_out, uni.c AS cw,
    log10((coalesce(uni.c, 0) + 0.5) / (size.n + 0.5 * (v + 1))) AS base,
    CASE WHEN bi.c IS NOT NULL THEN log10(CASE WHEN bi.c <= 5 THEN d[bi.c] ELSE 1 END * bi.c / below)
         WHEN back.h IS NOT NULL THEN log10(q / below / (1 - seen)) + log10(coalesce(p1.p, unk.p))
         ELSE log10(coalesce(p1.p, unk.p)) END AS lp
  FROM token LEFT JOIN uni USING (x) LEFT JOIN p1 USING (x) LEFT JOIN bi USING (h, x) LEFT JOIN back USING (h), disc, size, unk WHERE o = 2
)
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(count(cw) AS BIGINT) AS n_known, CAST((SELECT n FROM size) AS BIGINT) AS train_tokens,
  round(sum(base), 6) AS base_score, round(sum(lp), 6) AS score
FROM scored GROUP BY r, doc_id, held_out
"""

OP9 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents
), shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE {_shingles('5')} END AS s FROM doc
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingled
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (SELECT DISTINCT a AS id, a AS seen FROM link UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.seen = link.a
), comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM shingled LEFT JOIN comp ON id = doc_id
"""

OP10 = r"""
WITH line AS (
  SELECT doc_id, i, l, sum(len(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(l) - 1 AS start
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), worded AS (
  SELECT doc_id, start, start + len(l) AS stop, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT *, regexp_extract_all(lower(l), '[\p{L}\p{N}_]+') AS w FROM line) WHERE len(w) > 0
), ended AS (
  SELECT a.doc_id, a.start, a.j, min(b.j) AS last FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.j BETWEEN a.j AND a.j + 19 AND b.upto - a.upto + len(a.w) >= 20 GROUP BY ALL
), unit AS (
  SELECT e.doc_id, e.start, CAST(max(c.stop) - e.start AS BIGINT) AS length, array_to_string(flatten(list(c.w ORDER BY c.j)), ' ') AS x, CAST(sum(len(c.w)) AS BIGINT) AS n_words
  FROM ended e JOIN worded c ON c.doc_id = e.doc_id AND c.j BETWEEN e.j AND e.last GROUP BY e.doc_id, e.start, e.j
), ranked AS (
  SELECT *, first_value(doc_id) OVER p AS first_doc_id, first_value(start) OVER p AS first_start, row_number() OVER p AS k FROM unit WINDOW p AS (PARTITION BY x ORDER BY doc_id, start)
)
SELECT doc_id, CAST(start AS BIGINT) AS start, length, n_words, first_doc_id, CAST(first_start AS BIGINT) AS first_start FROM ranked WHERE k > 1
"""

_CRC = """bytes AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL
), crc_step AS (
  SELECT k, 0 AS i, CAST(4294967295 AS UBIGINT) AS c FROM bytes
  UNION ALL
  SELECT k, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, CAST(ascii(substr(k, i // 9 + 1, 1)) AS UBIGINT))
                        WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END
  FROM crc_step WHERE i < 9 * len(k)
), crc AS (SELECT k, xor(c, CAST(4294967295 AS UBIGINT)) AS crc32_of FROM crc_step WHERE i = 9 * len(k)
)"""


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


_TREE = """{name} AS (
  SELECT tree, 0 AS lvl, i, digest, count(*) OVER (PARTITION BY tree) AS m FROM {start}
  UNION ALL
  SELECT tree, lvl + 1, i // 16, digest, count(*) OVER (PARTITION BY tree)
  FROM (SELECT tree, lvl, i // 16 * 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name} WHERE m > 1 GROUP BY tree, lvl, i // 16 * 16)
)"""

OP12 = f"""
WITH RECURSIVE {_CRC}, doc AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS digest,
    CASE WHEN crc32_of % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents) LEFT JOIN crc USING (k)
), leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM doc
), {_TREE.format(name='node', start='leaf')}, subroot AS (
  SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS i, digest FROM node WHERE m = 1
), {_TREE.format(name='top', start='subroot')}, step AS (
  SELECT l.doc_id, l.tree, l.i, n.lvl, string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < l.i >> (4 * n.lvl)) AS before, string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > l.i >> (4 * n.lvl)) AS after
  FROM leaf l JOIN node n ON l.tree = n.tree AND n.m > 1 AND n.i >> 4 = l.i >> (4 * n.lvl + 4) GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, l.tree, l.i, 100 + n.lvl, string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < s.i >> (4 * n.lvl)), string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > s.i >> (4 * n.lvl))
  FROM leaf l JOIN subroot s ON l.tree = s.source JOIN top n ON n.m > 1 AND n.i >> 4 = s.i >> (4 * n.lvl + 4) GROUP BY ALL
), ordered AS (
  SELECT tree, i, coalesce(before, '') AS before, coalesce(after, '') AS after, lvl, row_number() OVER (PARTITION BY tree, i ORDER BY lvl) AS k FROM step
), proof AS (SELECT tree, i, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256, max(k) AS steps FROM ordered GROUP BY tree, i
), fold AS (
  SELECT tree, i, 0 AS k, coalesce(changed, digest) AS digest FROM leaf
  UNION ALL
  SELECT f.tree, f.i, f.k + 1, sha256(o.before || f.digest || o.after) FROM fold f JOIN ordered o ON f.tree = o.tree AND f.i = o.i AND o.k = f.k + 1
), root AS (SELECT digest AS root FROM top WHERE m = 1
)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM leaf l JOIN subroot s ON l.tree = s.source LEFT JOIN proof p ON p.tree = l.tree AND p.i = l.i JOIN fold f ON f.tree = l.tree AND f.i = l.i AND f.k = coalesce(steps, 0), root
"""


def _rounds(n: int) -> str:
    """Centroids c0, c1, ... and the assignments a0, a1, ... to them."""
    one = """a{k} AS MATERIALIZED (
  SELECT r, arg_min(k, d * 16 + k) AS k, min(d) AS d
  FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM vec, c{k}) GROUP BY r
), c{next} AS MATERIALIZED (
  SELECT o.k, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (
    SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
      SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS j FROM a{k} JOIN vec USING (r)) GROUP BY k, j) GROUP BY k) n ON o.k = n.k
)"""
    return ", ".join(one.format(k=k, next=k + 1) for k in range(n + 1))


OP13 = f"""
WITH vec AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM vec ORDER BY sha256('3:' || vec_id) LIMIT 8
), {_rounds(10)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN vec USING (r) JOIN c10 USING (k)
"""

ORACLES = {"op6_decontamination": OP6, "op8_katz": OP8, "op9_near_duplicates": OP9, "op12_manifest": OP12, "op13_clusters": OP13, "repeated_lines": OP10}
