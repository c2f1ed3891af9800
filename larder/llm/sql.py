"""DuckDB statements that say what the operators' queries return."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM cut)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y
    WHERE 100 * common >= 75 * (p.n + q.n - common)
), reach AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION SELECT node, y FROM reach JOIN link ON x = other
), component AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN size USING (doc_id) JOIN component ON node = doc_id
"""

CONTAMINATION = r"""
WITH lowered AS (
    SELECT doc_id, NULL AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL
    SELECT NULL, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), doc AS (
    SELECT doc_id, w, len(w) AS n FROM lowered WHERE item_id IS NULL
), item AS (
    SELECT item_id, w, len(w) AS n, least(len(w), 13) AS m FROM lowered WHERE item_id IS NOT NULL AND len(w) > 0
), win AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s
    FROM (SELECT item_id, w, m, unnest(generate_series(1, n - m + 1)) AS i FROM item)
), gram AS (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
    FROM (SELECT doc_id, w, m, unnest(generate_series(1, n - m + 1)) AS i
          FROM doc, (SELECT DISTINCT m FROM item) WHERE n >= m)
), met AS (
    SELECT doc_id, i, gram.m AS m, item_id FROM gram JOIN win ON gram.s = win.s AND gram.m = win.m
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM met) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id
)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

VECTOR_LINKS = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION SELECT node, y FROM reach JOIN link ON x = other
), component AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
), degree AS (
    SELECT x, count(*) AS n FROM link GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON node = vec_id LEFT JOIN degree ON x = vec_id
"""

TOOL_CALLS = r"""
WITH RECURSIVE turns AS (
    SELECT *, length(text) AS n, regexp_extract(text, '[A-Za-z]+') AS word FROM conversations
), call AS (
    SELECT 'call_' || conv_id || '_' || turn AS call_id, conv_id, turn, n, word,
        CASE WHEN n % 19 = 0 THEN 'unlisted' WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'fetch'
             ELSE 'calculate' END AS name,
        CASE WHEN n % 29 = 0 THEN 'call_' || conv_id || '_' || turn
             WHEN turn > 2 AND n % 2 = 0 THEN 'call_' || conv_id || '_' || (turn - 2) END AS needed
    FROM turns WHERE role = 'assistant'
), result AS (
    SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content
    FROM turns WHERE role = 'user' AND turn > 0
), level AS (
    SELECT call_id, 0 AS level FROM call
    WHERE needed IS NULL OR needed NOT IN (SELECT call_id FROM call)
    UNION ALL
    SELECT c.call_id, l.level + 1 FROM call c JOIN level l ON c.needed = l.call_id
), judged AS (
    SELECT *,
        CASE WHEN n % 3 = 0 THEN '{"limit":' || CASE WHEN n % 11 = 0 THEN '"many"' ELSE CAST(n % 50 AS VARCHAR) END
                                 || ',"query":"' || word || '"}'
             WHEN n % 3 = 1 AND n % 13 = 0 THEN '{"timeout":2.5}'
             WHEN n % 3 = 1 THEN '{"timeout":' || (n % 7) || ',"url":"https://example.org/' || word || '"'
                                 || CASE WHEN n % 17 = 0 THEN ',"verbose":true' ELSE '' END || '}'
             WHEN n % 23 = 0 THEN NULL
             ELSE '{"exact":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END
                              || ',"terms":[' || n || ',' || (n % 9) || ']}' END AS arguments
    FROM call
), wrong AS (
    SELECT *, CASE
        WHEN name = 'unlisted' THEN CASE WHEN arguments IS NULL THEN 'json,tool' ELSE 'tool' END
        WHEN arguments IS NULL THEN 'json'
        WHEN name = 'search' AND n % 11 = 0 THEN 'type:limit'
        WHEN name = 'fetch' AND n % 13 = 0 THEN 'missing:url'
        WHEN name = 'fetch' AND n % 17 = 0 THEN 'unknown:verbose'
        ELSE '' END AS problems
    FROM judged
)
SELECT call_id, conv_id, turn, level,
    CASE WHEN w.call_id IS NULL THEN 'orphan' WHEN level IS NULL THEN 'cyclic'
         WHEN content IS NULL THEN 'pending' ELSE 'linked' END AS status,
    problems,
    '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR)
        || ',"name":' || coalesce(CAST(to_json(name) AS VARCHAR), 'null')
        || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS message
FROM wrong w FULL JOIN result r USING (call_id) LEFT JOIN level USING (call_id)
"""

URL_LISTS = r"""
WITH capture AS (
    SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
        lower(split_part(split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '?', 1), '#', 1)) AS host
    FROM pages
), host AS (
    SELECT DISTINCT host AS domain FROM capture
), parent AS (
    SELECT DISTINCT split_part(domain, '.', -2) || '.' || split_part(domain, '.', -1) AS domain FROM host
), drawn AS (
    SELECT 'block' AS list, domain, CAST('0x' || left(md5(domain), 8) AS BIGINT) AS x, 'host' AS kind FROM host
    UNION ALL SELECT 'allow', domain, CAST('0x' || left(md5(domain), 8) AS BIGINT), 'host' FROM host
    UNION ALL SELECT 'block', domain, CAST('0x' || left(md5(domain), 8) AS BIGINT), 'parent' FROM parent
), event AS (
    SELECT list, domain, true AS on_, x % 200 AS day FROM drawn WHERE kind = 'host' AND list = 'block' AND x % 4 = 0
    UNION SELECT list, domain, false, x % 200 + 60 FROM drawn WHERE kind = 'host' AND list = 'block' AND x % 12 = 0
    UNION SELECT list, domain, true, x % 200 + 120 FROM drawn WHERE kind = 'host' AND list = 'block' AND x % 24 = 0
    UNION SELECT list, domain, true, x % 300 FROM drawn WHERE kind = 'host' AND list = 'allow' AND x % 10 = 1
    UNION SELECT list, domain, true, x % 150 FROM drawn WHERE kind = 'parent' AND x % 3 = 0
), daily AS (
    SELECT list, domain, DATE '2024-01-01' + CAST(day AS INTEGER) AS day, bool_or(on_) AS on_ FROM event GROUP BY ALL
), changed AS (
    SELECT *, coalesce(lag(on_) OVER (PARTITION BY list, domain ORDER BY day), false) AS was FROM daily
), spell AS (
    SELECT list, domain, on_, day AS since, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until
    FROM changed WHERE on_ <> was
), met AS (
    SELECT page_id, s.*, row_number() OVER (
        PARTITION BY page_id ORDER BY length(s.domain) DESC, list = 'allow' DESC, s.domain DESC, since DESC) AS place
    FROM capture c JOIN spell s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
    WHERE on_ AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT c.page_id, host, fetched, CASE WHEN list IS NULL THEN 'none' ELSE list END AS verdict,
       m.domain AS matched, since
FROM capture c LEFT JOIN (SELECT * FROM met WHERE place = 1) m USING (page_id)
"""

LEXICAL_RANKS = r"""
WITH doc_word AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), item_word AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_word GROUP BY ALL
), size AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), whole AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size
), damped AS (
    SELECT doc_id, 100 - 25 + (25 * n * docs) // words AS m FROM size, whole
), weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, whole GROUP BY term, docs
), scored AS (
    SELECT item_id, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM item_word JOIN tf USING (term) JOIN weight USING (term) JOIN damped USING (doc_id)
    GROUP BY ALL HAVING score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 20
"""


def _moved(i: int) -> str:
    """One round: book{i} from the pieces nearest to each entry of the book before it."""
    return f"""
near{i} AS (
    SELECT piece.vec_id, piece.part, first(piece.v) AS v, min((list_dot_product(piece.v, piece.v)
        - 2 * list_dot_product(piece.v, book.v) + list_dot_product(book.v, book.v))::BIGINT * 256 + entry) AS best
    FROM piece JOIN book{i - 1} AS book ON piece.part = book.part GROUP BY ALL
), mean{i} AS (
    SELECT part, entry, list(x ORDER BY place) AS v
    FROM (SELECT part, entry, place, floor(sum(x) / count(*)) AS x
          FROM (SELECT part, best % 256 AS entry, unnest(v) AS x, unnest(generate_series(1, len(v))) AS place FROM near{i})
          GROUP BY ALL)
    GROUP BY ALL
), book{i} AS (
    SELECT part, entry, coalesce(mean{i}.v, book.v) AS v
    FROM book{i - 1} AS book LEFT JOIN mean{i} USING (part, entry)
), """


VECTOR_CODES = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), piece AS (
    SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM kept, range(4) AS parts (part)
), book0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
    FROM piece QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256
), {_moved(1)}{_moved(2)}{_moved(3)}{_moved(4)}{_moved(5)}whole AS (
    SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS digest
    FROM book4
), coded AS (
    SELECT vec_id, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code,
           sum(best // 256)::BIGINT AS error
    FROM near5 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN kept USING (vec_id), whole
"""
