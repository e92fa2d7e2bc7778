"""DuckDB SQL of the opN_ queries that SQL can express over whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS ps FROM win SEMI JOIN twice USING (s) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[q] FOR q IN range(1, len(w) + 1) IF NOT list_contains(ps, q)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS r FROM d UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.u)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id, n.n
"""

OP6 = """
WITH good AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

# bytes as hexadecimal digits, cut into blocks first, because a substring costs its distance from the start
OP1 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(doc_id, 9223372036854775807) AS place, hex(encode(COALESCE(text, ''))) AS h FROM documents),
block AS (SELECT row, place, o, substr(h, 2 * o + 1, 2098) AS s FROM d, unnest(range(0, len(h) // 2, 1000)) AS t(o)),
win AS (SELECT row, place, o + i AS p, substr(s, 2 * i + 1, 100) AS w FROM block, unnest(range(0, least(1000, len(s) // 2 - 49))) AS u(i)),
first AS (SELECT w, min(place) AS m FROM win GROUP BY w HAVING min(place) < max(place)),
hit AS (SELECT DISTINCT row, p FROM win JOIN first USING (w) WHERE m < place),
run AS (SELECT row, p, sum(fresh) OVER (PARTITION BY row ORDER BY p) AS g FROM (SELECT row, p, CASE WHEN p > lag(p) OVER (PARTITION BY row ORDER BY p) + 50 THEN 1 ELSE 0 END AS fresh FROM hit)),
span AS (SELECT row, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY row, g),
gap AS (SELECT row, a, b, COALESCE(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS since FROM span),
cut AS (SELECT row, sum(b - a) AS n, count(*) AS spans, max(b) AS stop, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gap JOIN d USING (row) GROUP BY row)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, COALESCE(spans, 0) AS n_spans, sha256(unhex(concat(kept, substr(h, 2 * COALESCE(stop, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN cut USING (row)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM s),
f AS (SELECT *, everything - COALESCE(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER () - COALESCE(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, arg_min(rest / weight_left, place) FILTER (lim > rest * weight / weight_left) OVER () AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, weight * level) END AS target, CAST(concat('0x', substr(md5(concat('17|', COALESCE('=' || source, 'null'))), 1, 10)) AS BIGINT) / 1099511627776.0::DOUBLE AS shift FROM l),
r AS (SELECT d.doc_id, d.size, t.*, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT *, CAST(least(floor(shift + rate * k) - floor(shift + rate * (k - 1)), ceil(rate)) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM c
"""

# on the given pages the article element bounds the main text, and these are all its references
OP11 = r"""
WITH cut AS (SELECT row_number() OVER () AS row, page_id, url, regexp_split_to_array(regexp_extract(COALESCE(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1)>') AS parts FROM pages),
clean AS (SELECT page_id, url, [trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g')) FOR x IN parts] AS parts FROM cut)
SELECT page_id, url, array_to_string([x FOR x IN parts IF x <> ''], chr(10)) AS text, CAST(length(array_to_string([x FOR x IN parts IF x <> ''], chr(10))) AS BIGINT) AS n_chars FROM clean
"""

# 16 equal words in a row at one lag are in every run of 24 words or more: 24 - q of them for small q, 2 * q for large q
OP12 = f"""
WITH crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])), lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h >> 1, 3988292384::BIGINT) ELSE h >> 1 END), 4294967295::BIGINT) AS h FROM (SELECT DISTINCT doc_id FROM documents)),
raw AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS w FROM documents),
sized AS (SELECT row, doc_id, w, len(w) AS n, h, h // 10 AS g FROM raw LEFT JOIN crc USING (doc_id)),
d AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1] FOR i IN range(n)] ELSE w END AS w FROM sized),
gram AS (SELECT row, n, i, hash(w[i + 1 : i + 16]) AS s FROM d, unnest(range(0, n - 15)) AS t(i)),
pair AS (SELECT a.row, b.i - a.i AS q, a.i FROM gram a JOIN gram b ON a.row = b.row AND a.s = b.s AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
island AS (SELECT row, q, min(i) AS start, count(*) + 15 + q AS length FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM pair) GROUP BY row, q, k),
run AS (SELECT row, start, length, min(q) AS period FROM island WHERE length >= greatest(24, 3 * q) GROUP BY row, start, length),
best AS (SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM run GROUP BY row),
top AS (SELECT row, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length * 1.0 / period DESC, start, period) AS k FROM run) WHERE k = 1),
gone AS (SELECT row, list_distinct(flatten(list(range(start + period, start + length)))) AS ps FROM run GROUP BY row)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(COALESCE(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i + 1] FOR i IN range(n) IF NOT list_contains(ps, i)] END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN best USING (row) LEFT JOIN top USING (row) LEFT JOIN gone USING (row)
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT lang, source, term, row, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n, count(*) AS docs FROM word GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS (SELECT lang, source, COALESCE(v, 0) AS v, COALESCE(x.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(c.n) AS total FROM c SEMI JOIN kept USING (lang, term) GROUP BY lang, source) x USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, COALESCE(c.n, 0) AS n, (1 + 1000000000 * (COALESCE(c.n, 0) + 2) // (g.total + 2 * g.v))::HUGEINT AS p FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, (1 + 1000000000 * (n + 2) // (total + 2 * v))::HUGEINT AS q FROM kept JOIN v USING (lang)),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, COALESCE(s.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS two, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL) s ON s.lang = x.lang AND s.one = x.source AND s.two = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op1_suffix_dedup": OP1, "op3_substring_dedup": OP3, "op5_mix_sources": OP5, "op6_exact_top_k": OP6, "op8_hyperminhash_dedup": OP8, "op11_html_extraction": OP11, "op12_periodic_runs": OP12, "op13_source_audit": OP13}
