"""DuckDB statements that give the rows of the dealt queries, where SQL can."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS window_words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents
), place AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS window_words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, n, item FROM place JOIN pattern USING (n, window_words)
), word AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
#: kind, rank, pattern, group, least length, as the scan has them
_SECRETS = [
    ("assign", 0, _ASSIGN, 2, 6), ("access", 1, "AKIA[A-Z0-9]+", 0, 20), ("hex", 2, "[0-9a-f]{24,}", 0, 24),
    ("pem", 3, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
]


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT r, '{kind}' AS kind, {rank} AS rank, s AS s, s + length(whole[i]) AS e
  FROM (
    SELECT r, whole, val, i,
      list_sum(list_transform(pieces[1 : i], lambda p: length(p))) + coalesce(list_sum(list_transform(whole[1 : i - 1], lambda p: length(p))), 0) AS s
    FROM (
      SELECT r, whole, val, pieces, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS val,
          string_split_regex(t, '{pattern}') AS pieces
        FROM doc WHERE regexp_matches(t, '{pattern}'))))
  WHERE length(val[i]) >= {least}"""


OP8 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
span AS ({" UNION ALL ".join(_spans(*s) for s in _SECRETS)}),
found AS (
  SELECT r,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (r)
"""

OP9 = rf"""
WITH rules(rule_host, rule_path, says) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), page AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), part AS (
  SELECT r, page_id, coalesce({_lower("regexp_extract(rest, '^[^/?#]*', 0)")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM page
), fit AS (
  SELECT r, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
    first(says ORDER BY length(rule_host || rule_path) DESC) AS says
  FROM part JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM part LEFT JOIN fit USING (r)
"""

OP11 = rf"""
WITH RECURSIVE piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), run AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece, (VALUES (1), (2), (3)) size(m) WHERE len(w) >= m) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM run WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM run WHERE f >= 10),
cover AS (
  SELECT lang, phrase, max(f) AS around FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM often WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM often WHERE m = 3) GROUP BY ALL
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 : m], ' ') AS rp
  FROM (SELECT lang, phrase, m, w, f AS a, unnest(range(1, m)) AS k FROM often LEFT JOIN cover USING (lang, phrase)
    WHERE m > 1 AND (around IS NULL OR 100 * around < 50 * f))
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
    CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut c JOIN run x ON x.lang = c.lang AND x.phrase = lp JOIN run y ON y.lang = c.lang AND y.phrase = rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best QUALIFY rank <= 2000
), edge AS (
  SELECT lang, phrase, f, array_to_string(w[1:2], ' ') AS a2, array_to_string(w[2:3], ' ') AS b2 FROM often WHERE m = 3
), inner_node AS (
  SELECT DISTINCT o.lang, o.phrase FROM often o JOIN edge i ON i.lang = o.lang AND i.b2 = o.phrase AND i.f = o.f
    JOIN edge u ON u.lang = o.lang AND u.a2 = o.phrase AND u.f = o.f WHERE o.m = 2
), walk AS (
  SELECT e.lang, e.phrase AS head, e.phrase, e.b2, 3 AS words FROM edge e
  WHERE NOT EXISTS (SELECT 1 FROM inner_node i WHERE i.lang = e.lang AND i.phrase = e.a2)
  UNION ALL SELECT k.lang, k.head, e.phrase, e.b2, k.words + 1 FROM walk k
    JOIN inner_node i ON i.lang = k.lang AND i.phrase = k.b2 JOIN edge e ON e.lang = k.lang AND e.a2 = k.b2
    JOIN often o ON o.lang = k.lang AND o.phrase = k.b2 AND o.f = e.f
), passage AS (
  SELECT lang, phrase, max(words) OVER (PARTITION BY lang, head) AS path_words FROM walk
)
SELECT lang, rank, phrase, a, l, r, n, score, CAST(coalesce(path_words, len(string_split(phrase, ' '))) AS BIGINT) AS path_words
FROM ranked JOIN total USING (lang) LEFT JOIN passage USING (lang, phrase)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_TERM}') AS w FROM documents
), size AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM doc WHERE len(w) > 0
), posting AS (
  SELECT d, len, term, count(*) AS tf FROM (SELECT d, len(w) AS len, unnest(w) AS term FROM doc) GROUP BY ALL
), item AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark)
  GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, size GROUP BY term, nd
), scored AS (
  SELECT q, item_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len * nd) // nt)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN posting USING (term), size GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN doc USING (d) WHERE score > 0 QUALIFY rank <= 10
"""

CHECKS = {
    "op4_benchmark_decontamination": OP4,
    "op8_secret_scan": OP8,
    "op9_url_filter": OP9,
    "op11_phrase_collocations": OP11,
    "op13_ranked_search": OP13,
}
