"""SQL (DuckDB) for the registered operators that SQL can express, written independently of the operators' plans."""

from __future__ import annotations

from skuflow.llm import license_scan

OP3 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w)
), least_id AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (
  SELECT doc_id, list(i) AS starts FROM win JOIN least_id USING (k) WHERE d < doc_id GROUP BY doc_id
), cover AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM hit
), kept AS (
  SELECT w.doc_id, words, gone,
         CASE WHEN gone IS NULL THEN words
              ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS left_words
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(left_words) AS BIGINT) AS n_removed,
       sha256(array_to_string(left_words, ' ')) AS kept_sha256
FROM kept
"""

_TEMPLATES = ", ".join(
    f"({n}, '{t.label}', string_split('{' '.join(t.words)}', ' '), string_split('{t.phrase}', ' '))" for n, t in enumerate(license_scan.TEMPLATES)
)

# Every template word is indexed. A file looks up the four rarest words of each template that it holds; where two of them agree
# on a beginning and the phrase follows, the words at their places are counted.
OP6 = rf"""
WITH template(t, label, words, phrase) AS (VALUES {_TEMPLATES}),
f AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), posting AS (
  SELECT t, word, k - 1 AS p FROM (SELECT t, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM template)
), hit AS (
  SELECT r, i - 1 AS pos, word FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM f)
  SEMI JOIN posting USING (word)
), frequency AS (
  SELECT word, count(DISTINCT r) AS df FROM hit GROUP BY word
), lookup AS (
  SELECT r, t, word FROM (SELECT DISTINCT r, word FROM hit) JOIN (SELECT DISTINCT t, word FROM posting) USING (word) JOIN frequency USING (word)
  QUALIFY row_number() OVER (PARTITION BY r, t ORDER BY df, word) <= 4
), beginning AS (
  SELECT r, t, pos - p AS b FROM lookup JOIN hit USING (r, word) JOIN posting USING (t, word) GROUP BY r, t, b HAVING count(DISTINCT word) >= 2
), phrase_at AS (
  SELECT t, label, phrase, min(k) - 1 AS q
  FROM (SELECT t, label, words, phrase, unnest(range(1, len(words) + 1)) AS k FROM template)
  WHERE words[k:k + len(phrase) - 1] = phrase GROUP BY t, label, phrase
), verified AS (
  SELECT r, t, label, b FROM beginning JOIN phrase_at USING (t) JOIN f USING (r)
  WHERE b + q >= 0 AND words[b + q + 1:b + q + len(phrase)] = phrase
), agreed AS (
  SELECT r, t, label, b, count(*) AS votes FROM verified JOIN posting USING (t) JOIN f USING (r)
  WHERE b + p >= 0 AND words[b + p + 1] = word GROUP BY r, t, label, b
), held AS (
  SELECT r, label, max(votes) / any_value(len(words)) AS score FROM agreed JOIN template USING (t, label) GROUP BY r, t, label
), place AS (
  SELECT r, i - 1 AS w, CASE WHEN words[i:i + 1] = ['cc', 'by'] THEN 'cc-by'
                             WHEN words[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl'
                             WHEN words[i:i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM f)
), base AS (
  SELECT r, count(*) AS n_base, min(w) AS first_word, max(w) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM place WHERE label IS NOT NULL GROUP BY r
), every AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM place WHERE label IS NOT NULL UNION ALL SELECT r, label FROM held) GROUP BY r
), best AS (SELECT r, max(score) AS score FROM held GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END), 6) AS score
FROM f LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""

_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?: ?[A-Z0-9][A-Z0-9]?[A-Z0-9]?)?"),
    ("secret", r"[0-9a-f]{32,}"),
    ("ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]"),
)
_SPLITS = " UNION ALL ".join(
    f"SELECT r, {n} AS no, '{kind}' AS kind, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS parts FROM d"
    for n, (kind, pattern) in enumerate(_PATTERNS)
)

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents),
cut AS ({_SPLITS}),
span AS (
  SELECT r, no, kind, parts[i] AS m, right(parts[i - 1], 40) AS before, left(parts[i + 1], 40) AS after,
         CAST(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(2, len(parts), 2)) AS i FROM cut WHERE len(parts) > 1)
), digit AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS plain,
         lower(before || ' ' || after) AS near,
         regexp_matches(before, '[A-Za-z0-9]$') OR regexp_matches(after, '^[A-Za-z0-9]') AS joined
  FROM span
), good AS (
  SELECT r, no, kind, kind || ':' || s || ':' || (s + length(m)) AS txt, s FROM digit
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
           CASE WHEN (length(digits) - k) % 2 = 0 THEN CAST(digits[k] AS INTEGER)
                WHEN CAST(digits[k] AS INTEGER) > 4 THEN 2 * CAST(digits[k] AS INTEGER) - 9 ELSE 2 * CAST(digits[k] AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT joined AND list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c:
           CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
    WHEN 'secret' THEN NOT joined AND length(m) <= 64 AND regexp_matches(near, 'token|secret|password|key|auth')
    WHEN 'ssn' THEN NOT (regexp_matches(before, '[0-9-]$') OR regexp_matches(after, '^[0-9-]'))
           AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(near, 'ssn|social security')
  END
), summed AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone, string_agg(txt, ',' ORDER BY no, s) FILTER (no < 4) AS base, string_agg(txt, ',' ORDER BY no, s) AS spans
  FROM good GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (r)
"""

OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS place, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, place) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# The CRC-32 of "<doc_id>:<run>" byte by byte, with its table worked out from the polynomial.
OP13 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), run AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c:
      CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS h
  FROM run, crc_table
), word AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), cut AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)
), pair AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, word.word FROM cut JOIN word ON rest = word.word
  UNION SELECT word.word, cut.word FROM cut JOIN word ON rest = word.word
), near AS (
  SELECT pair.word, other, n AS other_n FROM pair JOIN word ON other = word.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM word w LEFT JOIN best b ON w.word = b.word
), step AS (
  SELECT word, word AS at, form AS next FROM found
  UNION ALL
  SELECT s.word, f.word, f.form FROM step s JOIN found f ON s.next = f.word
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN step s ON s.word = f.word AND s.next IS NULL
"""

ORACLE: dict[str, str] = {"op3_substring_dedup": OP3, "op6_license_scan": OP6, "op8_pii": OP8, "op12_exact_search": OP12, "op13_spelling_variants": OP13}
