"""DuckDB SQL for the operators that SQL can express."""

CRC = """
crc_table(entries) AS (
    SELECT list(entry ORDER BY b) FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
        FROM (SELECT unnest(range(256)) AS b)
    )
)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; `entries` of crc_table is in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE {CRC},
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
),
grouped AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT run, times, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM grouped, crc_table),
noisy AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
    FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
    SELECT word, n, gap, substr(word, 1, gap) || substr(word, gap + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS gap FROM words)
),
near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.gap = b.gap AND a.word <> b.word
    UNION
    SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION
    SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
),
ranked AS (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
        row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place
    FROM near
),
forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
        CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
        CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
),
paths(word, root, step) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL
    SELECT p.word, f.form, p.step + 1 FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, step) AS root FROM paths GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""

RESAMPLING = rf"""
WITH {CRC},
doc_words AS (
    SELECT row, doc_id, unnest(words) AS word FROM (
        SELECT row_number() OVER () AS row, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents
    )
),
doc_counts AS (SELECT row, doc_id, word, count(*) AS times FROM doc_words GROUP BY ALL),
target_words AS (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
),
hashed AS (
    SELECT word, {crc32("word")} % 10000 AS bucket
    FROM (SELECT word FROM doc_counts UNION SELECT word FROM target_words), crc_table
),
s AS (SELECT bucket, sum(times) AS s FROM doc_counts JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS tt),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ss / ((coalesce(s, 0) + 1)::DOUBLE * tt)))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket), totals
),
sums AS (
    SELECT row, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight
    FROM doc_counts JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) d LEFT JOIN sums USING (row)
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""
