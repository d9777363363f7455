"""Queries of this subpackage in DuckDB's SQL, written from their definitions alone."""

#: Everything the rules measure; ``docs`` has a row number ``rid``. White space is listed, since `\s` differs by engine.
_MEASURED = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM {documents}),
words AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
windows AS (
  SELECT * FROM (
    SELECT rid, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY p))
  WHERE w3 IS NOT NULL),
repeated AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p + d) AS n_repeat_words FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
counted AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measured AS (
  SELECT docs.rid, doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN counted USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * word_chars
      OR 100 * n_dup_lines > 30 * n_lines) AS any_failed
  FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(any_failed::INT)::BIGINT AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (
  SELECT *, f / n AS m FROM (
    SELECT sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(f * f / n::DOUBLE) AS ff, sum(n::DOUBLE * n) AS nn, count(*)::DOUBLE AS hosts FROM hosts)),
excess AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 THEN (ff - n * m * m) / (m * (1 - m)) - (hosts - 1) END AS e, n - nn / n - (hosts - 1) AS room
  FROM moments),
prior AS (
  SELECT m, CASE WHEN e > 0 AND room > 0 THEN greatest(1.0, least(1000.0, room / e - 1)) ELSE 1000.0 END AS k FROM excess),
verdicts AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS host_ok FROM hosts, prior)
"""

QUALITY_RULES = f"""
WITH {_MEASURED.replace("{documents}", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(host_ok, true)) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""

#: Distinct shingles of each text; ``docs`` has a row number ``rid`` and the words ``ws`` in lower case (A-Z only).
_SHINGLES = r"""
{name}_docs AS (
  SELECT row_number() OVER () AS rid, {id}, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM {source}),
{name}_shingles AS (
  SELECT DISTINCT rid, {id}, s FROM (
    SELECT rid, {id}, unnest(CASE
        WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
    FROM {name}_docs))
"""


def shingles(name: str, source: str, id_: str) -> str:
    return _SHINGLES.replace("{name}", name).replace("{source}", source).replace("{id}", id_)


#: Needs ``d_docs`` and ``d_shingles``; gives ``grouped`` with a row per document.
_GROUPED = """
sizes AS (SELECT rid, doc_id, count(*) AS n FROM d_shingles GROUP BY rid, doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM d_shingles a JOIN d_shingles b USING (s)
  WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d_docs
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
grouped AS (
  SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
  FROM d_docs LEFT JOIN sizes USING (rid, doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id))
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {shingles("d", "documents", "doc_id")}, {_GROUPED}
SELECT doc_id, n_shingles, component_id, kept FROM grouped
"""

#: Items here have five words or more, as all items of the tables have.
_LEAKS = """
item_sizes AS (SELECT rid, count(*) AS q FROM i_shingles GROUP BY rid),
leaked AS (
  SELECT d_shingles.rid AS drid, doc_id, item_id, max(q)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared
  FROM i_shingles JOIN item_sizes USING (rid) JOIN d_shingles USING (s)
  GROUP BY d_shingles.rid, doc_id, i_shingles.rid, item_id
  HAVING 100 * count(*) >= 75 * max(q))
"""

LEAKS = f"""
WITH {shingles("d", "documents", "doc_id")}, {shingles("i", "benchmark", "item_id")}, {_LEAKS}
SELECT doc_id, item_id, n_item_shingles, n_shared FROM leaked
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || chr(10) || coalesce(text, '')) AS digest
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(place % 3 + 1)::INT] AS weight FROM sources
), filled AS (
  SELECT *, row_number() OVER stopping AS turn,
         1.5::DOUBLE * sum(source_size) OVER () - (sum(2.0::DOUBLE * source_size) OVER stopping - 2.0::DOUBLE * source_size) AS left_over,
         sum(weight) OVER () - (sum(weight) OVER stopping - weight) AS open_weight
  FROM weighed WINDOW stopping AS (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT left_over, open_weight, turn AS first_open FROM filled
  WHERE 2.0::DOUBLE * source_size * open_weight > left_over * weight ORDER BY turn LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR turn < first_open THEN 2.0::DOUBLE * source_size
              ELSE weight * level.left_over / level.open_weight END AS target
  FROM filled LEFT JOIN level ON true
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM targets
), cumulated AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole,
         CASE WHEN s.whole < 2 THEN s.target - s.whole * s.source_size ELSE 0 END AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
), chosen AS (
  SELECT *, (whole + CASE WHEN before + size <= extra AND extra > 0 OR before <= extra AND 2 * (extra - before) > size THEN 1 ELSE 0 END)::BIGINT AS times
  FROM cumulated
)
SELECT doc_id, size, source_size, target, size * times AS taken FROM chosen
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, regexp_extract_all(unnest(string_split_regex(lowered, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
      FROM documents))
  WHERE len(words) > 0
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces
), grams AS (
  SELECT lang, width, array_to_string(words[pos:pos + width - 1], ' ') AS phrase
  FROM starts, (SELECT unnest(range(1, 6)) AS width) WHERE pos + width - 1 <= len(words)
), counted AS MATERIALIZED (
  SELECT lang, width, phrase, string_split(phrase, ' ') AS words, count(*)::BIGINT AS f FROM grams GROUP BY lang, width, phrase
  HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:width], ' ') AS rest
  FROM counted, unnest(range(1, 5)) AS cut(k) WHERE k < width
), cuts AS (
  SELECT p.lang, p.phrase, p.a, p.k, t.n, x.f AS l, y.f AS r, 1000::HUGEINT * p.a * t.n // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN totals t ON t.lang = p.lang
  JOIN counted x ON x.lang = p.lang AND x.phrase = p.head JOIN counted y ON y.lang = p.lang AND y.phrase = p.rest
), weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1
), held AS (
  SELECT lang, array_to_string(words[pos:pos + size - 1], ' ') AS phrase, max(f) AS f
  FROM counted, unnest(range(2, 5)) AS s(size), unnest(range(1, 5)) AS b(pos)
  WHERE size < width AND pos + size - 1 <= width GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase
  WHERE h.f IS NULL OR 100 * h.f < 100 * w.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
