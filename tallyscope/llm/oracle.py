"""DuckDB SQL for the corpus queries that SQL can express."""

OP4 = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce('s' || source, 'null') AS source_key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/mix') AS shuffle_key
    FROM documents
), sources AS (
    SELECT source_key, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1, 2
), placed AS (
    SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place,
           sum(source_size) OVER ()::BIGINT AS total, source_size * 2 AS most FROM sources
), weighed AS (
    SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM placed
), ordered AS (
    SELECT *, total * 1.5::DOUBLE AS budget,
           coalesce(sum(most) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped_before,
           sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left
    FROM weighed
), stops AS (
    SELECT *, (budget - stopped_before) * weight >= most * weight_left AS stopped FROM ordered
), shares AS (
    SELECT *, budget - (sum(CASE WHEN stopped THEN most ELSE 0 END) OVER ())::BIGINT AS left_over,
           (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::BIGINT AS open FROM stops
), targets AS (
    SELECT source_key, source_size,
           CASE WHEN stopped THEN most::DOUBLE ELSE weight * (left_over / nullif(open, 0)) END AS target
    FROM shares
), reached AS (
    SELECT s.*, t.source_size, t.target,
           (sum(size) OVER (PARTITION BY source_key ORDER BY shuffle_key, size ROWS UNBOUNDED PRECEDING))::BIGINT AS reached
    FROM sized s JOIN targets t USING (source_key)
), copies AS (
    SELECT *, (reached + copy * source_size) / target AS finish
    FROM reached, (VALUES (0), (1)) AS c(copy) WHERE size > 0
), stream AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source_key, shuffle_key, size, copy ROWS UNBOUNDED PRECEDING) AS until
    FROM copies
), used AS (
    SELECT doc_id, source_key, shuffle_key, size, reached, count(*) AS copies FROM stream
    WHERE until <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY ALL
)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * coalesce(u.copies, 0))::BIGINT AS taken
FROM reached r LEFT JOIN used u
  ON u.doc_id IS NOT DISTINCT FROM r.doc_id AND u.source_key = r.source_key
 AND u.shuffle_key = r.shuffle_key AND u.size = r.size AND u.reached = r.reached
"""

OP2 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100
              THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

#: Stretches of six equal words at a distance tell every run, as its words match at least six in a row.
OP11 = r"""
WITH bits AS (
    SELECT doc_id, text,
           list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)) AS crc
    FROM documents
), hashed AS (
    SELECT doc_id, xor(crc, 4294967295::BIGINT) AS h, xor(crc, 4294967295::BIGINT) // 10 AS g,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS original
    FROM bits
), planned AS (
    SELECT *, len(original)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(original) > 0 THEN g % len(original) END AS a FROM hashed
), placed AS (
    SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planned
), words AS (
    SELECT doc_id, i, original[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END + 1] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), grams AS (
    SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w,
                                lead(word, 4) OVER w, lead(word, 5) OVER w) AS gram,
           lead(word, 5) OVER w IS NOT NULL AS whole
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), alike AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q
    FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i
    WHERE x.whole AND y.whole
), islands AS (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period
    FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs,
           max({'length': length, 'start': -start, 'period': -period}) AS longest,
           string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r
      ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length
), kept AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed
    FROM words w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, -l.longest.start AS start, l.longest.length AS length,
       -l.longest.period AS period, (1000 * l.longest.length) // (-l.longest.period) AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP12 = r"""
WITH lowered AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (
    SELECT doc_id, terms, len(terms)::BIGINT AS n FROM lowered WHERE len(terms) > 0
), totals AS (
    SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS terms FROM sized
), counted AS (
    SELECT doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * t.documents + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counted, totals t GROUP BY term, t.documents
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT a.item_id, c.doc_id,
           sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * c.n * t.documents) // t.terms))))::BIGINT AS score
    FROM asked a JOIN weighed w USING (term) JOIN counted c USING (term), totals t GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""

STATEMENTS: dict[str, str] = {"op2_warc": OP2, "op4_mixing": OP4, "op11_periodic": OP11, "op12_lexical": OP12}
