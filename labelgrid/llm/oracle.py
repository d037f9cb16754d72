"""DuckDB SQL for the queries of this subpackage that SQL can express."""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * word_chars OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept FROM b
"""

LINES = r"""
WITH l AS (SELECT doc_id, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
k AS (SELECT *, array_to_string(w, ' ') AS k, len(w) AS n FROM l),
f AS (SELECT k, any_value(w) AS w, any_value(n) AS n, min((doc_id, pos)) AS place FROM k WHERE n > 0 GROUP BY k),
v AS (SELECT k, n, place, j, array_to_string(w[1 : j - 1] || w[j + 1 : n], ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM f WHERE n >= 8)),
s AS (SELECT n, j, v, min(place) AS place FROM v GROUP BY ALL),
near AS (
  SELECT v.k FROM v JOIN s USING (n, j, v) WHERE s.place < v.place
  UNION SELECT v.k FROM v JOIN f ON f.k = v.v AND f.n >= 8 WHERE f.place < v.place
  UNION SELECT f.k FROM v JOIN f ON f.k = v.v AND f.n >= 8 WHERE v.place < f.place),
m AS (SELECT k.doc_id, k.pos, k.line, k.n > 0 AND (near.k IS NOT NULL OR f.place <> (k.doc_id, k.pos)) AS gone
  FROM k LEFT JOIN f USING (k) LEFT JOIN near ON near.k = k.k),
t AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(kept, '')) AS kept_sha256, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars FROM documents d LEFT JOIN t USING (doc_id)
"""

_DIGITS = ", ".join(f"('0x' || h[{5 * i + 1}:{5 * i + 5}])::INT" for i in range(8))

ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, html, [{_DIGITS}] AS n, min(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(n, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // q) % 32 + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM b
"""

FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

PREFIX_TRIE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(sha256(role) || text)) AS t FROM t GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) % 9 AS h FROM l),
r AS (SELECT h.conv_id, coalesce(g.t[1 : h.h], []) || h.t[h.h + 1 :] AS t FROM h LEFT JOIN l g ON g.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(t) AS n, d, t[1 : d] AS k FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(k[d].text) ELSE 0 END AS saved FROM n LEFT JOIN c USING (d, k)),
s AS (SELECT a AS d, k[1 : a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (d, k) LEFT JOIN n u ON u.d = m.d - 1 AND u.k = m.k[1 : m.d - 1]
"""

EXACT = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL = {"op3_quality_cascade": QUALITY, "op4_line_dedup": LINES, "op9_content_archive": ARCHIVE, "op11_fill_in_middle": FILL_MIDDLE, "op12_prefix_trie": PREFIX_TRIE, "op13_exact_dedup": EXACT}
