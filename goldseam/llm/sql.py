"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from goldseam.llm import decontamination, line_dedup, mixing, periodic_runs

EXACT_DEDUP = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER keepers AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER keepers = 1 AS kept,
       sha256(norm) AS text_sha256
FROM rows
WINDOW keepers AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

LINE_DEDUP = rf"""
WITH split AS (
    SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n
    FROM split
), hashed AS (
    SELECT *, ('0x' || md5(line)[1:{line_dedup.HASH_DIGITS}])::BIGINT AS h FROM lines
), cut AS (
    SELECT *, i = n OR ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)
                         % {line_dedup.MODULUS} * {line_dedup.BASE} + h)
                        % {line_dedup.MODULUS}) % {line_dedup.DIVISOR} = 0 AS last
    FROM hashed
), numbered AS (
    SELECT *, coalesce(sum(last::INT) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0) AS chunk_no
    FROM cut
), chunks AS (
    SELECT doc_id, chunk_no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
    FROM numbered GROUP BY doc_id, chunk_no
), judged AS (
    SELECT *, n > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]')
              AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, chunk_no) > 1
              AS removed
    FROM chunks
), cleaned AS (
    SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (removed), 0) AS n_removed,
           coalesce(string_agg(chunk, chr(10) ORDER BY chunk_no) FILTER (NOT removed), '') AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN c.text END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE c.n_lines END::BIGINT AS n_lines,
       CASE WHEN d.text IS NULL THEN 0 ELSE c.n_removed END::BIGINT AS n_removed
FROM documents d JOIN cleaned c USING (doc_id)
"""

MIXING = f"""
WITH counted AS (
    SELECT source, count(*) AS n, pow(count(*), 0.5) AS share FROM documents GROUP BY source
), rated AS (
    SELECT source, (SELECT sum(n) FROM counted) * share / (SELECT sum(share) FROM counted) / n
           AS rate
    FROM counted
), blocked AS (
    SELECT source, greatest(ceil(rate / {mixing.BLOCK}), 1)::BIGINT AS blocks,
           rate / greatest(ceil(rate / {mixing.BLOCK}), 1) AS mean
    FROM rated
), mass AS (
    SELECT source, mean, unnest(range(0, (ceil(mean + 12 * sqrt(mean)) + 25)::BIGINT)) AS k
    FROM blocked
), table_of AS (
    SELECT source, sum(exp(-mean) * pow(mean, k) / gamma(k + 1))
                   OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM mass
), tried AS (
    SELECT doc_id, d.source, text, unnest(range(1, blocks + 1)) AS block
    FROM documents d JOIN blocked b ON d.source IS NOT DISTINCT FROM b.source
), drawn AS (
    SELECT doc_id, t.source, text, block, count(cdf) AS draw
    FROM (
        SELECT *, ('0x' || md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''),
                                         block::VARCHAR))[1:{mixing.UNIFORM_DIGITS}])::BIGINT
                  / pow(16, {mixing.UNIFORM_DIGITS}) AS u
        FROM tried
    ) t
    LEFT JOIN table_of c ON t.source IS NOT DISTINCT FROM c.source AND c.cdf <= t.u
    GROUP BY ALL
), counts AS (
    SELECT doc_id, source, text, sum(draw)::BIGINT AS copies FROM drawn GROUP BY ALL
), copied AS (
    SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM counts
)
SELECT doc_id, source, copy, text,
       md5(concat_ws('|', '{mixing.SEED}', 'order', coalesce(doc_id::VARCHAR, ''), copy::VARCHAR))
           AS order_key
FROM copied
"""

DECONTAMINATION = rf"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), sized AS (
    SELECT item, words, least(len(words), {decontamination.WINDOW}) AS width
    FROM items WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item, width, array_to_string(words[pos + 1:pos + width], ' ') AS said
    FROM (SELECT *, unnest(range(0, len(words) - width + 1)) AS pos FROM sized)
), places AS (
    SELECT r, width, pos, array_to_string(words[pos + 1:pos + width], ' ') AS said
    FROM (
        SELECT r, words, width, unnest(range(0, len(words) - width + 1)) AS pos
        FROM texts, (SELECT DISTINCT width FROM sized)
    )
), occurring AS (
    SELECT r, width, pos, item FROM places JOIN windows USING (width, said)
), hit AS (
    SELECT r, count(DISTINCT place)::BIGINT AS n_hit
    FROM (SELECT r, unnest(range(pos, pos + width)) AS place FROM occurring) GROUP BY r
), named AS (
    SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS said
    FROM (SELECT DISTINCT r, item FROM occurring) GROUP BY r
), ends AS (  -- consecutive windows of one item in a document make a longer match
    SELECT DISTINCT o.r, o.pos, w.item, w.pos AS item_at, o.width
    FROM places o JOIN (
        SELECT item, width, pos, array_to_string(words[pos + 1:pos + width], ' ') AS said
        FROM (SELECT *, unnest(range(0, len(words) - width + 1)) AS pos FROM sized)
    ) w USING (width, said)
), chains AS (
    SELECT r, item, pos - item_at AS diagonal, pos, width,
           pos - row_number() OVER (PARTITION BY r, item, pos - item_at ORDER BY pos) AS chain
    FROM ends
), longest AS (
    SELECT r, max_by(first, (long, -first)) AS longest_at, max(long) AS longest
    FROM (
        SELECT r, min(pos) AS first, (count(*) + max(width) - 1)::BIGINT AS long
        FROM chains GROUP BY r, item, diagonal, chain
    ) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest,
       longest_at::BIGINT AS longest_at
FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""

PERIODIC_RUNS = rf"""
WITH hashed AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           xor(list_reduce(  -- crc32 of the decimal digits, bit by bit
               list_prepend(4294967295::BIGINT,
                            list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), range(8)),
                   lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
               )
           ), 4294967295::BIGINT) AS h
    FROM documents
), sized AS (
    SELECT *, len(words) AS n, h // 10 AS g, coalesce(h % 10 = 0, FALSE) AS repeated FROM hashed
), placed AS (
    SELECT *, g % nullif(n, 0) AS a, 1 + (n - g % nullif(n, 0)) // (3 + g % 8) AS p FROM sized
), said AS (
    SELECT r, n, i, words[1 + CASE WHEN repeated AND i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM (SELECT *, unnest(range(0, n)) AS i FROM placed)
), pairs AS (
    SELECT x.r, x.i, y.i - x.i AS q
    FROM said x JOIN said y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 2
), stretches AS (
    SELECT r, q, min(i) AS start, count(*) AS same
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
    GROUP BY r, q, island
    HAVING count(*) >= q AND count(*) + q >= {periodic_runs.LEAST}
), runs AS (  -- multiples of the smallest period make the same stretch
    SELECT r, start, same + q AS length, min(q) AS period FROM stretches GROUP BY r, start, same + q
), top AS (
    SELECT r, arg_min(struct_pack(start, length, period), (-length, start, period)) AS run,
           count(*) AS n_runs,
           string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY r
), dropped AS (
    SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM said ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, run.start::BIGINT AS start,
       run.length::BIGINT AS length, run.period::BIGINT AS period,
       (1000 * run.length // run.period)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM placed LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""


def statements() -> dict[str, str]:
    return {
        "op2_exact_dedup": EXACT_DEDUP,
        "op7_line_dedup": LINE_DEDUP,
        "op10_source_mixing": MIXING,
        "op11_periodic_runs": PERIODIC_RUNS,
        "op13_decontamination": DECONTAMINATION,
    }
