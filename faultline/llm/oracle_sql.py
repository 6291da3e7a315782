"""Checking SQL of the corpus operators, for DuckDB."""

from faultline.llm.licences import TEMPLATES

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = """
WITH c AS (
  SELECT vec_id, list_aggregate(list_transform(embedding,
         lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code
  FROM embeddings WHERE len(embedding) = 64),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, hamming(q.code, c.code) AS distance
  FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""

LINE_WORDS = "len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"

OP2 = f"""
WITH a AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text <> ''),
w AS (SELECT doc_id, ln, line, {LINE_WORDS} AS words FROM a),
n AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, ln) AS pos,
         sum(words) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM w WHERE words > 0),
r AS (
  SELECT x.pos AS s, y.pos AS e FROM n AS x JOIN n AS y ON x.doc_id = y.doc_id AND y.pos >= x.pos
  WHERE y.upto - y.words < x.upto - x.words + 50 AND y.upto >= x.upto - x.words + 50
  UNION
  SELECT x.pos, y.pos FROM n AS x JOIN n AS y ON x.doc_id = y.doc_id AND y.pos >= x.pos
  WHERE x.upto - x.words <= y.upto - 50 AND x.upto > y.upto - 50),
c AS (
  SELECT s, e, string_agg(line, chr(10) ORDER BY pos) AS run
  FROM r JOIN n ON n.pos BETWEEN s AND e GROUP BY s, e),
g AS (
  SELECT DISTINCT n.pos FROM (SELECT *, min(s) OVER (PARTITION BY run) AS head FROM c) AS x
  JOIN n ON n.pos BETWEEN s AND e WHERE s > head),
m AS (
  SELECT w.doc_id, w.ln, w.line, CASE WHEN n.pos IS NULL THEN NULL ELSE g.pos IS NOT NULL END AS gone
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id AND n.ln = w.ln LEFT JOIN g ON g.pos = n.pos),
k AS (
  SELECT doc_id, ln, line, coalesce(
    last_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln),
    first_value(gone IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS gone FROM m),
t AS (
  SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone) AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines,
       CASE WHEN coalesce(kept, '') = '' THEN 0 ELSE len(string_split(kept, chr(10))) END AS n_kept,
       sha256(coalesce(kept, '')) AS text_sha256
FROM documents AS d LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
t AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM t),
c AS (
  SELECT r, count(DISTINCT i + k) AS n FROM h CROSS JOIN (VALUES (0), (1), (2)) AS o(k)
  WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_bangs
  FROM d LEFT JOIN c ON c.r = d.r),
v AS (
  SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (100 * n_bangs > 30 * n_words)::INT AS BIGINT) AS fail_bits FROM v)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS pos FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
levels AS (
  SELECT 3.0 * a.source_size / a.weight AS level,
         CAST((SELECT sum(source_size) FROM s) - coalesce(sum(CASE WHEN
             3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight
             THEN 3 * b.source_size END), 0) AS DOUBLE) AS rest,
         CAST(sum(CASE WHEN 3.0 * b.source_size / b.weight >= 3.0 * a.source_size / a.weight
             THEN b.weight END) AS DOUBLE) AS open_weight
  FROM s AS a CROSS JOIN s AS b GROUP BY a.source, a.source_size, a.weight),
best AS (
  SELECT rest, open_weight FROM levels WHERE rest / open_weight <= level ORDER BY level LIMIT 1),
t AS (
  SELECT source, source_size, CASE
           WHEN rest * CAST(weight AS DOUBLE) / open_weight > CAST(3 * source_size AS DOUBLE)
           THEN CAST(3 * source_size AS DOUBLE)
           ELSE rest * CAST(weight AS DOUBLE) / open_weight END AS target
  FROM s CROSS JOIN best),
n AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM t),
o AS (
  SELECT source, pos, CAST(sum(size) AS BIGINT) AS here FROM d GROUP BY source, pos),
m AS (
  SELECT o.*, n.source_size, target, whole,
         CAST(floor(target) AS BIGINT) - whole * source_size AS need,
         CAST(sum(here) OVER (PARTITION BY o.source ORDER BY pos) AS BIGINT) - here AS before
  FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source)
SELECT d.doc_id, d.size, m.source_size, m.target,
       d.size * whole + CASE WHEN before + here <= need THEN d.size
         WHEN before < need THEN d.size * (need - before) // here ELSE 0 END AS taken
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.pos = m.pos
"""

ALNUM = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
TEMPLATE_ROWS = ", ".join(
    "({}, '{}', '{}')".format(n, name, text.replace("'", "''")) for n, (name, text) in enumerate(TEMPLATES)
)

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS w FROM documents),
s AS (
  SELECT r, i, list_slice(w, i + 1, i + 5) AS g FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM d)),
k AS (SELECT n, licence, {ALNUM} AS w FROM (VALUES {TEMPLATE_ROWS}) AS v(n, licence, text)),
p AS (
  SELECT DISTINCT n, licence, len(w) - 4 AS t, list_slice(w, i + 1, i + 5) AS g
  FROM (SELECT n, licence, w, unnest(range(len(w) - 4)) AS i FROM k)),
z AS (SELECT n, count(*) AS shingles FROM p GROUP BY n),
h AS (
  SELECT r, p.n, licence, p.g, CAST(floor(i / t) AS BIGINT) - back AS win
  FROM s JOIN p ON s.g = p.g CROSS JOIN (VALUES (0), (1)) AS o(back)),
f AS (
  SELECT r, n, licence, win FROM h WHERE win >= 0 GROUP BY r, n, licence, win
  HAVING count(DISTINCT g) >= 0.8 * (SELECT shingles FROM z WHERE z.n = h.n)),
a AS (
  SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_windows
  FROM f GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_windows, 0) AS n_windows
FROM d LEFT JOIN a ON a.r = d.r
"""

CRC32 = """
WITH RECURSIVE bits AS (
  SELECT 0 AS step, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS c FROM range(256) AS t(n)
  UNION ALL SELECT step + 1, n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY n) AS steps FROM bits WHERE step = 8)"""

ORDER = 4  # characters of context
REST = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
GRAMS = "\n".join(
    f"""g{k} AS (
  SELECT right(gram, {k + 1}) AS gram, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b
  FROM g GROUP BY ALL),"""
    for k in range(ORDER + 1)
)
CHANCE = """CASE WHEN sum({0}) OVER w > 0
    THEN (CAST({0} AS DOUBLE) + CAST(count_if({0} > 0) OVER w AS DOUBLE) * {1})
         / (CAST(sum({0}) OVER w AS DOUBLE) + CAST(count_if({0} > 0) OVER w AS DOUBLE)) ELSE {1} END"""
CHANCES = "\n".join(
    f"""p{k} AS (
  SELECT x.gram, {CHANCE.format("x.a", "y.pa" if k else "(1e0 / 71)")} AS pa,
         {CHANCE.format("x.b", "y.pb" if k else "(1e0 / 71)")} AS pb
  FROM g{k} AS x {f"JOIN p{k - 1} AS y ON y.gram = right(x.gram, {k})" if k else ""}
  WINDOW w AS (PARTITION BY left(x.gram, {k}))),"""
    for k in range(ORDER + 1)
)

OP11 = f"""
{CRC32},
h AS (
  SELECT page_id, url, {REST} AS rest,
         translate(regexp_extract({REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract({REST}, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN {FITS.format("example.net", "/en/")} THEN 'example.net/en/'
                 WHEN {FITS.format("example.com", "/de/")} THEN 'example.com/de/'
                 WHEN {FITS.format("org", "/fr/")} THEN 'org/fr/'
                 WHEN {FITS.format("net", "/")} THEN 'net/' END AS rule FROM h),
u AS (
  SELECT url, any_value(rule) IN ('example.net/en/', 'org/fr/') AS good,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(url))),
             lambda i: CAST(('0x' || substr(hex(encode(url)), 2 * i + 1, 2)) AS BIGINT))),
           lambda a, x: xor(a >> 8, any_value(steps)[(xor(a, x) & 255) + 1]))) % 5 = 0 AS held,
         repeat(chr(2), {ORDER}) || regexp_replace(
           translate(any_value(rest), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20-\\x7e]', chr(4), 'g') || chr(3) AS chars
  FROM r CROSS JOIN crc WHERE contains(url, '://') GROUP BY url),
o AS (
  SELECT url, good, held, substr(chars, CAST(i AS BIGINT), {ORDER + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(chars) - {ORDER - 1})) AS i FROM u)),
g AS (
  SELECT gram, count(*) FILTER (good AND NOT held) AS a, count(*) FILTER (NOT good AND NOT held) AS b FROM o GROUP BY gram),
{GRAMS}
{CHANCES}
l AS (SELECT gram, CAST(round(ln(pa / pb) * 1000000) AS BIGINT) AS ratio FROM p{ORDER}),
s AS (
  SELECT url, any_value(good) AS good, any_value(held) AS held,
         CAST(sum(ratio) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS score
  FROM o JOIN l ON l.gram = o.gram GROUP BY url),
z AS (SELECT *, CAST(floor(score / 10000) AS BIGINT) AS step FROM s),
c AS (SELECT step, count_if(good) AS good, count_if(NOT good) AS bad FROM z WHERE held AND good IS NOT NULL GROUP BY step),
e AS (
  SELECT step, coalesce(lag(step) OVER (ORDER BY step) + 1, step) AS free,
         CAST(coalesce(sum(good) OVER below, 0) AS DOUBLE) * CAST(sum(bad) OVER () AS DOUBLE)
         + CAST(sum(bad) OVER () - coalesce(sum(bad) OVER below, 0) AS DOUBLE) * CAST(sum(good) OVER () AS DOUBLE) AS errors,
         sum(good) OVER () > 0 AND sum(bad) OVER () > 0 AS known
  FROM c WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (
  SELECT coalesce((SELECT CAST(ceil((step + free) / 2) AS BIGINT) FROM e WHERE known ORDER BY errors, step LIMIT 1), 0) AS mark)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN step >= mark THEN 'allow' ELSE 'block' END AS verdict, score / 1000000 AS score
FROM r LEFT JOIN z ON z.url = r.url CROSS JOIN m
"""

OP12 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
         p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, negative_id,
       positive_score, negative_score
FROM n WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)
QUALIFY row_number() OVER w <= 10
"""

FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
OP13 = f"""
{CRC32},
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({LEAF.format(n_chars="n_chars")}) AS leaf,
         sha256({LEAF.format(n_chars="(CAST(n_chars AS HUGEINT) + 1)")}) AS more, n_chars,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1]))) AS sum
  FROM documents CROSS JOIN crc),
i AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d),
v AS (
  SELECT lang, 0 AS l, k, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM i
  UNION ALL
  SELECT lang, l + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 1) // 2
  FROM v WHERE n > 1 GROUP BY lang, l, k // 2),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM v WHERE n = 1),
t AS (
  SELECT 0 AS l, k, h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT l + 1, k // 2, sha256(string_agg(h, '' ORDER BY k)), (any_value(n) + 1) // 2
  FROM t WHERE n > 1 GROUP BY l, k // 2),
tall AS (SELECT lang, max(l) AS high FROM v GROUP BY lang),
b AS (  -- what stands beside or, at the last of an odd run, nothing
  SELECT i.r, v.l, v.h, v.k < (i.k >> v.l) AS on_left
  FROM i JOIN v ON v.lang IS NOT DISTINCT FROM i.lang AND v.n > 1 AND v.k = xor(i.k >> v.l, 1)
  UNION ALL
  SELECT i.r, tall.high + t.l, t.h, t.k < (s.k >> t.l)
  FROM i JOIN tall ON tall.lang IS NOT DISTINCT FROM i.lang JOIN s ON s.lang IS NOT DISTINCT FROM i.lang
  JOIN t ON t.n > 1 AND t.k = xor(s.k >> t.l, 1)),
p AS (SELECT r, sha256(string_agg(h, '' ORDER BY l)) AS proof FROM b GROUP BY r),
f AS (
  SELECT r, 0 AS l, CASE WHEN doc_id IS NOT NULL AND sum % 7 = 0 AND n_chars IS NOT NULL THEN more ELSE leaf END AS h,
         tall.high + (SELECT max(l) FROM t) AS high
  FROM i JOIN tall ON tall.lang IS NOT DISTINCT FROM i.lang
  UNION ALL
  SELECT f.r, f.l + 1, sha256(CASE WHEN b.on_left THEN b.h || f.h ELSE f.h || coalesce(b.h, '') END), high
  FROM f LEFT JOIN b ON b.r = f.r AND b.l = f.l WHERE f.l < high)
SELECT i.doc_id, leaf, s.h AS subroot, (SELECT h FROM t WHERE n = 1) AS root,
       coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root,
       f.h = (SELECT h FROM t WHERE n = 1) AS verified
FROM i JOIN s ON s.lang IS NOT DISTINCT FROM i.lang JOIN f ON f.r = i.r AND f.l = f.high
LEFT JOIN p ON p.r = i.r
"""

ORACLES = {
    "op1_topk_codes": OP1,
    "op2_line_dedup": OP2,
    "op3_quality_rules": OP3,
    "op5_mix_sources": OP5,
    "op7_licence_scan": OP7,
    "op11_url_filter": OP11,
    "op12_hard_negatives": OP12,
    "op13_manifest": OP13,
}
