"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

_UNIT = r"'[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+){3,}?[^\x20\x09-\x0D]*[.!?,;:](?:[\x20\x09\x0B-\x0D]+|$)|.+'"

SUBSTRING_DEDUP = rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k, len(l) AS n FROM split
), cut AS (
  SELECT doc_id, k, n, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, {_UNIT}, 0, 's') END AS u FROM lines
), pieces AS (
  SELECT doc_id, k, j, u[j] || CASE WHEN j = len(u) AND k < n THEN chr(10) ELSE '' END AS piece
  FROM (SELECT doc_id, k, n, u, unnest(generate_series(1, len(u))) AS j FROM cut)
), keyed AS (
  SELECT doc_id, k, j, piece, trim(regexp_replace(translate(piece, {_UPPER}, {_LOWER}), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key,
         coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM pieces
), worded AS (
  SELECT doc_id, k, j, len(string_split(key, ' ')) AS words, row_number() OVER (PARTITION BY key ORDER BY doc_id, k, j) > 1 AS again,
         row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS pos
  FROM keyed WHERE key <> ''
), runs AS (
  SELECT doc_id, k, j, words, again, pos - row_number() OVER (PARTITION BY doc_id, again ORDER BY pos) AS run FROM worded
), judged AS (
  SELECT doc_id, k, j, again AND sum(words) OVER (PARTITION BY doc_id, again, run) >= 35 AS gone FROM runs
), marked AS (
  SELECT p.doc_id, p.k, p.j, p.piece, p.start,
         coalesce(last_value(g.gone IGNORE NULLS) OVER (PARTITION BY p.doc_id ORDER BY p.k, p.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS gone
  FROM keyed p LEFT JOIN judged g ON g.doc_id = p.doc_id AND g.k = p.k AND g.j = p.j
), spans AS (
  SELECT doc_id, min(start)::BIGINT AS start, max(start + length(piece))::BIGINT AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - row_number() OVER (PARTITION BY doc_id, gone ORDER BY k, j) AS run FROM marked)
  WHERE gone GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, count(*) AS n, sum(stop - start)::BIGINT AS chars, string_agg(start || '-' || stop, ',' ORDER BY start) AS listed FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY k, j) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id
)
SELECT t.doc_id, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.chars, 0)::BIGINT AS removed_chars, coalesce(r.listed, '') AS removed, t.text
FROM kept t LEFT JOIN removed r ON r.doc_id = t.doc_id
"""

_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORD}) AS w, string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORD}) AS gap FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_WORD}) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT g.doc_id, g.k, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits
), placed AS (
  SELECT doc_id, p, sum(g + before) OVER (PARTITION BY doc_id ORDER BY p) AS start, size
  FROM (SELECT doc_id, p, length(gap[p]) AS g, CASE WHEN p > 1 THEN length(w[p - 1]) ELSE 0 END AS before, length(w[p]) AS size
        FROM (SELECT doc_id, w, gap, unnest(generate_series(1, len(w))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM hits)))
), runs AS (
  SELECT c.doc_id, min(start)::BIGINT AS start, max(start + size)::BIGINT AS stop
  FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM covered) c JOIN placed USING (doc_id, p) GROUP BY c.doc_id, run
), spans AS (
  SELECT doc_id, string_agg(start || '-' || stop, ',' ORDER BY start) AS spans FROM runs GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
), totals AS (
  SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(s.spans, '') AS spans
FROM d LEFT JOIN totals c USING (doc_id) LEFT JOIN items t USING (doc_id) LEFT JOIN spans s USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT p.x, p.y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * p.c >= 80 * (nx.n + ny.n - p.c)
), both_ways AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT b.y AS doc_id, r.root FROM r JOIN both_ways b ON b.x = r.doc_id WHERE r.root < b.y
)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, t.component_id, t.doc_id = t.component_id AS kept
FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) t LEFT JOIN n ON n.doc_id = t.doc_id
"""

_ESCAPED = "'\\\\|\"|</?(?:turn|image|audio|document|unknown)\\b'"
_PROBE = "'\\### Assistant: </turn> ok'"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE} UNION ALL SELECT -7, 1, 'assistant', {_PROBE}
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(role) + length(text) + len(regexp_extract_all(role, {_ESCAPED})) + len(regexp_extract_all(text, {_ESCAPED})))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

# DuckDB has no crc32: its eight steps a byte are written out


def _crc(digits: str) -> str:
    steps = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v // 2, 3988292384 * (v % 2)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {steps}), 4294967295)"


_SIX_HOURS = "21600000000"

ASOF = f"""
WITH c0 AS (
  SELECT DISTINCT click_id, client_id, epoch_us(ts) AS t, {_crc("click_id::VARCHAR")} AS h FROM clicks
), c AS (
  SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN t - t % {_SIX_HOURS} ELSE t END AS ts_us FROM c0
), s0 AS (
  SELECT sale_id, client_id, epoch_us(sold_at) AS t, floor(100 * total + 0.5)::BIGINT AS total_cents, priority, {_crc("sale_id::VARCHAR")} AS h FROM sales
), s1 AS (
  SELECT sale_id, client_id, CASE WHEN h % 2 = 1 THEN t - t % {_SIX_HOURS} ELSE t END AS sold_us, total_cents, priority, h FROM s0
), s AS (
  SELECT * FROM s1 UNION ALL SELECT -1 - sale_id, client_id, sold_us, total_cents, 6 - priority, h FROM s1 WHERE h % 3 <> 0
), best AS (
  SELECT client_id, sold_us, count(*) AS n_tied, arg_max(o, (o.total_cents IS NOT NULL, coalesce(o.total_cents, 0), o.sale_id IS NOT NULL, coalesce(o.sale_id, 0))) AS o
  FROM (SELECT client_id, sold_us, {{'total_cents': total_cents, 'sale_id': sale_id, 'priority': priority}} AS o FROM s WHERE client_id IS NOT NULL AND sold_us IS NOT NULL)
  GROUP BY client_id, sold_us
), found AS (
  SELECT c.click_id, c.client_id, c.ts_us, b.sold_us, b.o, b.n_tied FROM c ASOF LEFT JOIN best b ON c.client_id = b.client_id AND c.ts_us >= b.sold_us
)
SELECT click_id, client_id, ts_us, CASE WHEN near THEN o.sale_id END AS sale_id, CASE WHEN near THEN ts_us - sold_us END AS lag_us,
       CASE WHEN near THEN o.total_cents END AS total_cents, CASE WHEN near THEN n_tied ELSE 0 END AS n_tied, CASE WHEN near THEN o.priority END AS priority
FROM (SELECT *, coalesce(ts_us - sold_us <= 720 * 3600000000, false) AS near FROM found)
"""

_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

LEXICAL_SEARCH = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_TERM}) AS w FROM documents
), lengths AS (
  SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_TERM})) AS term FROM benchmark
), occurs AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM occurs, total GROUP BY term, n_docs
), scored AS (
  SELECT a.item_id, l.r, l.doc_id, sum(w.weight * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * l.n * t.n_docs) // t.n_terms))))::BIGINT AS score
  FROM asked a JOIN occurs o USING (term) JOIN weights w USING (term) JOIN lengths l USING (r), total t GROUP BY a.item_id, l.r, l.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op3_near_dedup": NEAR_DEDUP, "op4_decontamination": DECONTAMINATION, "op5_substring_dedup": SUBSTRING_DEDUP, "op8_chat": CHAT, "op12_asof_join": ASOF, "op13_lexical_search": LEXICAL_SEARCH}
