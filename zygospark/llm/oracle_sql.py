"""The operators' results as SQL over the given tables, where SQL can say the same."""

WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW_WORDS = rf"""regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+')"""
ALNUM_WORDS = rf"""regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {LOW_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 75 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT id, min(seen) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.id = d.doc_id
"""

REMOVED_REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS turn FROM g) WHERE turn > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS places FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(places, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 2] AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM twice) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS (
  SELECT lang, source, unnest([
    {{'metric': 'word_length', 'v': word_chars / n_words}}, {{'metric': 'symbols', 'v': n_symbols / n_words}},
    {{'metric': 'dup_lines', 'v': n_dup_lines / n_lines}}, {{'metric': 'repeats', 'v': n_repeat_words / n_words}}]) AS x
  FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, x.metric AS metric, CASE WHEN x.v > 0 THEN ceil(ln(x.v) / ln(1.02))::INT END AS bucket, count(*) AS n FROM m GROUP BY ALL),
levels AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM s
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM s GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM s GROUP BY metric, bucket),
u AS (
  SELECT level, lang, source, metric, coalesce(pow(1.02, bucket) * (2 / 2.02), 0) AS v, sum(n) OVER (PARTITION BY level, lang, source, metric) AS rows,
    sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket NULLS FIRST) AS upto
  FROM levels),
q AS (
  SELECT level, lang, source, metric, max(rows) AS rows, min(v) FILTER (upto >= ceil(rows * 0.1)) AS lo, min(v) FILTER (upto >= ceil(rows * 0.5)) AS mid,
    min(v) FILTER (upto >= ceil(rows * 0.9)) AS hi
  FROM u GROUP BY ALL),
best AS (
  SELECT a.lang, a.source, a.metric, CASE WHEN a.rows >= 100 THEN a WHEN b.rows >= 100 THEN b ELSE c END AS q
  FROM q a JOIN q b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric JOIN q c ON c.level = 2 AND a.metric = c.metric
  WHERE a.level = 0),
t AS (
  SELECT lang, source,
    max(q.mid + greatest(1.25, 3 * (q.hi - q.mid))) FILTER (metric = 'word_length') AS long, max(q.mid - greatest(1.25, 3 * (q.mid - q.lo))) FILTER (metric = 'word_length') AS short,
    max(q.mid + greatest(0.1, 3 * (q.hi - q.mid))) FILTER (metric = 'symbols') AS symbols, max(q.mid + greatest(0.4, 3 * (q.hi - q.mid))) FILTER (metric = 'dup_lines') AS dup_lines,
    max(q.mid + greatest(0.4, 3 * (q.hi - q.mid))) FILTER (metric = 'repeats') AS repeats
  FROM best GROUP BY lang, source),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    CASE WHEN base_failed THEN 'base' WHEN word_chars / n_words > long OR word_chars / n_words < short THEN 'word_length' WHEN n_symbols / n_words > symbols THEN 'symbols'
      WHEN n_dup_lines / n_lines > dup_lines THEN 'dup_lines' WHEN n_repeat_words / n_words > repeats THEN 'repeats' END AS failed
  FROM b LEFT JOIN t ON b.lang IS NOT DISTINCT FROM t.lang AND b.source IS NOT DISTINCT FROM t.source)
SELECT *, failed IS NULL AS kept FROM f
"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS words FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
g AS (SELECT doc_id, k, i, w[i:i + k - 1] AS words FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
hits AS (SELECT doc_id, i, g.k, item_id FROM g JOIN t ON g.k = t.k AND g.words = t.words),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, list(item ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) ks(k) WHERE len(w) >= k)
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2
), cuts AS (
    SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:k], ' ') AS two
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), scored AS (
    SELECT lang, phrase, a, l.f AS l, r.f AS r, n,
        ((1000::HUGEINT * a * n::HUGEINT) // (l.f::HUGEINT * r.f))::BIGINT AS score, cut
    FROM cuts JOIN (SELECT lang, phrase AS one, f FROM counts) l USING (lang, one)
        JOIN (SELECT lang, phrase AS two, f FROM counts) r USING (lang, two) JOIN totals USING (lang)
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), covered AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
    GROUP BY ALL
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest s LEFT JOIN covered c USING (lang, phrase) WHERE c.f IS NULL OR 100 * c.f < 100 * s.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""

# The checksum goes bit by bit; 3988292384 is its polynomial.  The repair keeps, row by row, the cheapest and then
# least audit of every state: '' nothing yet, 's', 'u', 'a' the role of the last row; an insertion step before each row.
CONVERSATIONS = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key
    FROM conversations
), summed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length(key) + 1),
        lambda i: [ascii(decode(key)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS kind
    FROM keyed
), rows AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM summed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows
), faulty AS (
    SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), tallied AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty) GROUP BY conv_id
), moves(state, c, next, role) AS (
    VALUES ('', 's', 's', NULL), ('', 'u', 'u', 'user'), ('s', 'u', 'u', 'user'), ('a', 'u', 'u', 'user'), ('u', 'a', 'a', 'assistant')
), repair AS (
    SELECT conv_id, n, 0 AS i, '' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM tallied
    UNION ALL
    SELECT conv_id, n, i, state, cost, audit, lines FROM (
        WITH opened AS (
            SELECT * FROM repair WHERE i <= n
            UNION ALL
            SELECT conv_id, n, i, m.next, cost + 2, audit || 'I', list_append(lines, m.role || ':')
            FROM repair JOIN moves m USING (state) WHERE i <= n AND m.role IS NOT NULL
            UNION ALL
            SELECT conv_id, n, i, m2.next, cost + 4, audit || 'II', lines || [m.role || ':', m2.role || ':']
            FROM repair JOIN moves m USING (state) JOIN moves m2 ON m2.state = m.next WHERE i <= n AND m.role IS NOT NULL AND m2.role IS NOT NULL
        ), stepped AS (
            SELECT conv_id, n, i + 1 AS i, state, cost, audit, lines FROM opened WHERE i = n
            UNION ALL
            SELECT o.conv_id, n, o.i + 1, state, cost + 3, audit || 'D', lines
            FROM opened o JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1
            UNION ALL
            SELECT o.conv_id, n, o.i + 1, m.next, cost + CASE WHEN m.c = f.c THEN 0 ELSE 2 END + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END,
                audit || CASE WHEN m.c = f.c THEN 'K' ELSE 'R' END, list_append(lines, CASE WHEN m.c = f.c THEN f.role ELSE m.role END || ':' || f.text)
            FROM opened o JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1 JOIN moves m USING (state)
            WHERE fault NOT IN ('blank', 'duplicate') AND (m.c = f.c OR m.role IS NOT NULL)
        )
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM stepped
    ) WHERE best = 1
), ends AS (
    SELECT * FROM repair WHERE i = n + 1 AND state IN ('', 'a')
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT e.conv_id, gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends e JOIN tallied t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
UNION ALL
SELECT DISTINCT conv_id, 0, 0, 0, 0, 0, 0, '', sha256('') FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM tallied t WHERE t.conv_id IS NOT DISTINCT FROM c.conv_id)
"""

TOP_PRODUCTS = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
