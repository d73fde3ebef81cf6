"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
FOLDED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, trim({FOLDED.format('line')}, {SPACE}) AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.top AS gone FROM keyed k LEFT JOIN heavy h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

URL_FILTERS = r"""
WITH urls AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, url, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, url
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict
            WHEN regexp_matches(low, '://[^/?#]*cheap-pills\.|://[^/?#]*\bcasino\b|://[^/?#]*\bfree-(?:porn|xxx)\b|/wp-login\.php\b|/checkout/(?:cart|payment)\b|\.exe(?:[?#]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM urls LEFT JOIN fitting USING (page_id, url)
"""

RUN_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# crc32 of a text's bytes, bit by bit
CRC32 = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(('0x' || substr(hex(encode({0})), 2 * i + 1, 2)) AS BIGINT) for i in range(octet_length(encode({0})))],
  lambda c, b: list_reduce([xor(c, b)] || [CAST(k AS BIGINT) for k in range(8)], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

IMPORTANCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {RUN_WORDS.format(FOLDED.format("coalesce(text, '')"))} AS ws FROM documents),
bench AS (SELECT {RUN_WORDS.format(FOLDED.format("coalesce(text, '')"))} AS ws FROM benchmark),
words AS (SELECT r, unnest(ws) AS w FROM docs), aims AS (SELECT unnest(ws) AS w FROM bench),
hashed AS (SELECT w, {CRC32.format('w')} % 10000 AS b FROM (SELECT w FROM words UNION SELECT w FROM aims)),
s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM aims JOIN hashed USING (w) GROUP BY b),
gain AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000) AS DOUBLE) / CAST((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
weights AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM words JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM docs LEFT JOIN weights USING (r)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place, count(*) OVER () AS total FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * total // 100 THEN place END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM final WHERE n_features < 20
"""

LEXICAL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {RUN_WORDS.format(FOLDED.format("coalesce(text, '')"))} AS ts FROM documents),
held AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM docs WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({RUN_WORDS.format(FOLDED.format("coalesce(text, '')"))}) AS t FROM benchmark) GROUP BY ALL),
post AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM corpus) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post GROUP BY t),
impact AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * (SELECT docs FROM corpus)) // (SELECT terms FROM corpus)))) AS v FROM post JOIN weight USING (t) JOIN held USING (r)),
scores AS (SELECT i, item_id, r, CAST(sum(times * v) AS BIGINT) AS score FROM asked JOIN impact USING (t) GROUP BY i, item_id, r),
ranked AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores JOIN held USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": LINE_DEDUP, "op3_url_filters": URL_FILTERS, "op11_importance_resampling": IMPORTANCE, "op12_lexical_search": LEXICAL,
}
