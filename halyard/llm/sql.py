"""SQL equivalents of corpus queries, for those that SQL can express."""

_NS = ", ".join(f"({n})" for n in range(2, 11))

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
line AS (SELECT doc_id, u.line AS line, u.k AS k FROM d, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k) u WHERE regexp_matches(u.line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS r FROM line) WHERE r > 1 GROUP BY 1),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, length(unnest(ws)) AS size FROM d),
gram AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, generate_subscripts(ws, 1) AS i FROM d), (VALUES {_NS}) v(n) WHERE i + n - 1 <= len(ws)),
seen AS (SELECT doc_id, n, i, g, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id, n, g) AS times FROM gram),
top AS (SELECT doc_id, n, max(times * (length(g) - n + 1)) AS chars FROM seen WHERE n <= 4 AND times > 1 GROUP BY ALL),
cover AS (SELECT doc_id, n, sum(size) AS chars FROM (SELECT DISTINCT doc_id, n, i + unnest(generate_series(0, n - 1)) AS i FROM seen WHERE n >= 5 AND r > 1) JOIN word USING (doc_id, i) GROUP BY ALL),
again AS (SELECT doc_id, count(*) AS words FROM (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 4)) AS i FROM seen WHERE n = 5 AND times > 1) GROUP BY 1),
most(n, share) AS (VALUES (2, 0.20), (3, 0.18), (4, 0.16), (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)),
share AS (SELECT doc_id, n, chars / word_chars::DOUBLE AS share FROM (SELECT * FROM top UNION ALL SELECT * FROM cover) JOIN base USING (doc_id)),
verdict AS (SELECT doc_id, max(CASE WHEN s.n >= 5 THEN s.share END) AS repeat_share, max(CASE WHEN s.n <= 4 THEN s.share END) AS top_share, bool_and(s.share <= m.share::DOUBLE) AS ok FROM share s JOIN most m USING (n) GROUP BY 1),
full_row AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.words, 0) AS n_repeat_words, coalesce(repeat_share, 0.0) AS repeat_share,
    coalesce(top_share, 0.0) AS top_share, coalesce(dup.chars / word_chars::DOUBLE, 0.0) AS line_share, coalesce(ok, true) AS ok
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN verdict USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND ok AND line_share <= 0.20 AS kept,
  repeat_share::DOUBLE AS repeat_share, top_share::DOUBLE AS top_share, line_share::DOUBLE AS line_share
FROM full_row
"""

#: Near-duplicates by their definition: pairs that share shingles are counted, and components are what is reachable over links.
OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS code FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.code = b.code AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY 1
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, coalesce(least, doc_id) >= doc_id AS kept FROM s LEFT JOIN c ON a = doc_id
"""

#: Passages of smaller documents by their definition: every 50-byte window, its smallest document, and the bytes that later windows cover.
OP8 = """
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, unnest(list_transform(range(0, CAST(octet_length(b) - 49 AS BIGINT)), lambda i: {'i': i, 's': b[i + 1:i + 50]})) AS w FROM t WHERE octet_length(b) >= 50
), m AS (
  SELECT w.s AS s, min(doc_id) AS least FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)
), d AS (
  SELECT doc_id, w.i AS i FROM w JOIN m ON w.s = m.s WHERE doc_id > least
), o AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM d
), k AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM o
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, k
), l AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r
), c AS (
  SELECT l.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(CASE WHEN a > before THEN hex(b[before + 1:a]) ELSE '' END, '' ORDER BY a) AS head, max(z) AS rest FROM l JOIN t ON t.doc_id = l.doc_id GROUP BY 1
)
SELECT t.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || CASE WHEN octet_length(b) > coalesce(rest, 0) THEN hex(b[coalesce(rest, 0) + 1:octet_length(b)]) ELSE '' END)) AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id
"""


def _settled(before: str, after: str) -> str:
    """One step of settling: the document of each source that comes nearest to what is missing or over."""
    return f"""
{after}_gap AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS gap FROM {before}),
{after}_pick AS (SELECT *, CASE WHEN size > 0 AND size < 2 * abs(gap) AND CASE WHEN gap > 0 THEN copies < 3 ELSE copies > 0 END THEN row_number() OVER (PARTITION BY source, size > 0 AND size < 2 * abs(gap) AND CASE WHEN gap > 0 THEN copies < 3 ELSE copies > 0 END ORDER BY abs(abs(gap) - size), draw, doc_id, size) END AS place FROM {after}_gap),
{after} AS (SELECT doc_id, draw, size, source, source_size, target, copies + CASE WHEN place = 1 THEN CAST(sign(gap) AS BIGINT) ELSE 0 END AS copies FROM {after}_pick)"""


#: The mix by its definition: targets, virtual finish times of three turns, the cut at the budget, and two steps of settling.
OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR), md5(text))) AS draw FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), v AS (
  SELECT *, coalesce(sum(source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before, sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM w WINDOW l AS (ORDER BY source_size / weight, source IS NULL, source)
), u AS (
  SELECT *, (total - 3 * size_before) * weight >= 3 * source_size * weight_from AS capped FROM v
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((total - 3 * coalesce(sum(source_size) FILTER (capped) OVER (), 0)) * weight AS DOUBLE) / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM u
), q AS (
  SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(turn * source_size + upto AS DOUBLE) / target ELSE 0.0 END AS finish FROM q, (VALUES (0), (1), (2)) x(turn)
), n AS (
  SELECT *, sum(size) OVER (ORDER BY finish, draw, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS used, (SELECT round(sum(target)) FROM t) AS budget FROM f
), c0 AS (
  SELECT doc_id, draw, size, source, source_size, target, count(*) FILTER (used <= budget AND finish * target - size / 2 <= target) AS copies FROM n GROUP BY ALL
),{_settled("c0", "c1")},{_settled("c1", "c2")}
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM c2
"""


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Collocations by their definition: all runs of 1 to 5 words counted, every cut scored, phrases as frequent as a longer one around them left out.
OP11 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), s AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM s, range(1, 6) r(k) WHERE i + k - 1 <= len(w)
), n AS (
  SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100
), i AS (
  SELECT lang, array_to_string(list_slice(w, o, o + m - 1), ' ') AS phrase, max(a) AS longer FROM f, range(2, 5) x(m), range(1, 5) y(o) WHERE m < k AND o + m - 1 <= k GROUP BY 1, 2
), c AS (
  SELECT f.* FROM f LEFT JOIN i ON i.lang = f.lang AND i.phrase = f.phrase WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)
), q AS (
  SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c, range(1, 5) x(cut), f l, f r, n
  WHERE cut < c.k AND l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, cut), ' ') AND r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ') AND n.lang = c.lang
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


def _shares(groups: str, out: str) -> str:
    """A level's posterior shares around the means of the level above."""
    return f"""
{out}_s AS (SELECT CASE WHEN x > 0 THEN least(greatest(1 / x - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM (SELECT sum(pow(bad - n * mean, 2.0) / (mean * (1 - mean)) - n) / nullif(sum(CAST(n AS DOUBLE) * (n - 1)), 0) AS x FROM {groups})),
{out}_o AS (SELECT *, (strength + 1) * (behind + 1) / (strength + behind + 2) - 1 AS own FROM {groups}, {out}_s),
{out} AS (SELECT *, (bad + own * mean) / (n + own) AS share, n + own AS sure FROM {out}_o)"""


def _suffixes(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def op12(suffixes: tuple[str, ...], limit: float, z: float) -> str:
    """Rules, then hosts by posterior bound."""
    label = lambda k: f"array_to_string(list_slice(p, greatest(len(p) - {k - 1}, 1), len(p)), '.')"
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_LOWER}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), k AS (
  SELECT *, TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})', 1) AS BIGINT) AS key FROM u
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1
), c AS (
  SELECT host, string_split(host, '.') AS p, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM k LEFT JOIN l ON k.key = l.doc_id GROUP BY 1
), h AS (
  SELECT host, n, bad, CASE WHEN {label(2)} IN ({_suffixes(suffixes)}) THEN {label(3)} ELSE {label(2)} END AS domain, CASE WHEN {label(2)} IN ({_suffixes(suffixes)}) THEN {label(2)} ELSE {label(1)} END AS suffix FROM c
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2
), f0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM h) AS mean, (SELECT sum(n) + 1.0::DOUBLE FROM h) AS behind FROM d0 GROUP BY 1
),{_shares("f0", "f1")}, d1 AS (
  SELECT d0.*, share AS mean, sure AS behind FROM d0 JOIN f1 ON d0.suffix = f1.suffix
),{_shares("d1", "d2")}, h1 AS (
  SELECT h.host, h.n, h.bad, share AS mean, sure AS behind FROM h JOIN d2 ON h.domain = d2.domain AND h.suffix = d2.suffix
),{_shares("h1", "h2")}, r AS (
  SELECT page_id, u.host, path, CAST(n AS BIGINT) AS n_labelled, CAST(bad AS BIGINT) AS n_bad, share - {z} * sqrt(share * (1 - share) / (sure + 1)) > {limit} AS blocked, CASE
    WHEN (u.host = 'example.net' OR ends_with(u.host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (u.host = 'example.com' OR ends_with(u.host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (u.host = 'org' OR ends_with(u.host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u JOIN h2 ON u.host = h2.host
)
SELECT page_id, host, path, rule, n_labelled, n_bad, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


#: Resampling by its definition. A CRC is the exclusive or of what each byte adds at its distance from the end, and of what the initial state adds.
OP13 = rf"""
WITH RECURSIVE t AS (
  SELECT i AS b, i AS v, 0 AS k FROM range(0, 256) x(i) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8
), t8 AS (
  SELECT b, v FROM t WHERE k = 8
), a AS (
  SELECT doc_id, regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ai AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM a
), bi AS (
  SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b
), g AS (
  SELECT doc_id, false AS aim, array_to_string(list_slice(w, i, i + k - 1), ' ') AS f, count(*) AS n FROM ai, range(1, 4) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
  UNION ALL SELECT NULL, true, array_to_string(list_slice(w, i, i + k - 1), ' '), count(*) FROM bi, range(1, 4) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), z AS (
  SELECT printf('%02X', b) AS b, v, 0 AS d FROM t8 UNION ALL SELECT 'init', 4294967295, 0
  UNION ALL SELECT z.b, xor(t8.v, z.v >> 8), d + 1 FROM z JOIN t8 ON t8.b = z.v & 255 WHERE d < (SELECT max(octet_length(encode(f))) FROM g)
), e AS (
  SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS len FROM (SELECT DISTINCT f FROM g)
), y AS (
  SELECT f, substr(x, 2 * j - 1, 2) AS b, len - j AS d FROM e, LATERAL (SELECT unnest(range(1, len + 1)) AS j) UNION ALL SELECT f, 'init', len FROM e
), q AS (
  SELECT f, xor(bit_xor(v), 4294967295) % 10000 AS bucket FROM y JOIN z ON z.b = y.b AND z.d = y.d GROUP BY 1
), s AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0) AS s, coalesce(sum(n) FILTER (aim), 0) AS t FROM g JOIN q ON q.f = g.f GROUP BY 1
), m AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM s)::DOUBLE / ((s + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM s)::DOUBLE))) AS BIGINT) AS gain FROM s
), v AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM g JOIN q ON q.f = g.f JOIN m ON m.bucket = q.bucket WHERE NOT aim GROUP BY 1
), o AS (
  SELECT a.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, coalesce(len(w), 0) >= 20 AS may,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || CAST(a.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM a LEFT JOIN v ON v.doc_id = a.doc_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS n FROM o
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 5 * n // 100 THEN place END AS rank FROM p
"""
