r"""DuckDB SQL with the results of the queries that SQL can express.

They give results only and are no second path of any operator. Token ids and counts (a tokenizer), lattice scores and
hash-dealt shards and blocks are beyond SQL; tests hold those against brute force.
"""

from __future__ import annotations

SPACES = r"'[\x20\x09-\x0D]+'"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {SPACES}), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, length(t) AS n_chars_all, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN d USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_capitals > 40 * n_chars_all OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept FROM b
"""

_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(ASCII_LOWER.format("coalesce(text, '')"))

OP6 = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
k AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM k),
d AS (SELECT doc_id, row_number() OVER () AS r, {_ITEM_WORDS} AS w FROM documents),
s AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows))),
f AS (SELECT r, item, n, p FROM s JOIN windows USING (n, win)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM f) GROUP BY 1),
o AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)
"""

OP7 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
z AS (SELECT r, doc_id, k, substr(h, 2000 * k + 1, 2100) AS z FROM (SELECT *, unnest(range(0, n_bytes // 1000 + 1)) AS k FROM n)),
s AS (SELECT r, doc_id, 1000 * k + j AS p, substr(z, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, length(z) // 2 - 49))) AS j FROM z)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT r, p FROM s JOIN f USING (s) WHERE first < doc_id),
e AS (SELECT r, p, sum(CAST(p > coalesce(before, -100) + 50 AS BIGINT)) OVER (PARTITION BY r ORDER BY p) AS span FROM (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM m)),
g AS (SELECT r, span, min(p) AS a, max(p) + 50 AS b FROM e GROUP BY 1, 2),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM g),
c AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (r) GROUP BY 1)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN c USING (r)
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, {SPACES}), lambda x: x <> '') AS w FROM documents),
k AS (SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS p FROM w)),
n AS (SELECT r, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM k a JOIN k b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT r AS a, r AS b FROM w UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT c.a AS r, min(doc_id) AS component_id FROM c JOIN w ON w.r = c.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN m USING (r)
"""

_CONTROL = ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<</END>>", "<s>")


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || '0')"
    for code, control in enumerate(_CONTROL, 1):
        out = f"replace({out}, '{control}', chr(92) || '{code}')"
    return out


OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t, IF(t = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' FROM range(2) v(t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 25 + length({_escaped("role")}) END) AS BIGINT) AS formatted_chars FROM c GROUP BY 1
"""

_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, n)) AS crc)"


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes, with the table `crc` at hand."""
    code = f"regexp_extract_all(hex(encode({text})), '..')"
    return f"xor(list_reduce(list_transform({code}, lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP11 = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
h AS (SELECT w, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, {_CRC_TABLE}),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
k AS (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS masked, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = k.cut UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = k.cut),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
c AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.further)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.further IS NULL
"""

_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), {SPACES}), lambda x: x <> '')"

OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS i, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT r, i, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT r, i, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT g, min(i) AS first FROM s GROUP BY 1),
h AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS x FROM s JOIN f USING (g) WHERE first < i),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d),
k AS (SELECT r, count(h.x) AS n_removed, string_agg(word, ' ' ORDER BY u.x) FILTER (h.x IS NULL) AS kept FROM u LEFT JOIN h USING (r, x) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

# Of words p apart, pairs at jp and (j + 1)p that stand within six equal pairs in a row point to the periods of a document.
OP13 = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h, h // 10 AS g FROM documents, {_CRC_TABLE}),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND doc_id IS NOT NULL AND len(w) > 0 THEN g % len(w) END AS a, 1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) AS q FROM t),
d AS (SELECT doc_id, r, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END]) END AS w FROM a),
u AS (SELECT r, word, x, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o AS six
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS x FROM d) WINDOW o AS (PARTITION BY r ORDER BY x)),
j AS (SELECT r, p, unnest(range(0, n - p, p)) AS i FROM (SELECT r, len(w) AS n, unnest(range(1, len(w) // 2 + 1)) AS p FROM d)),
e AS (SELECT j.r, p, i FROM j JOIN u b ON b.r = j.r AND b.x = i + p JOIN u c ON c.r = j.r AND c.x = i WHERE b.word = c.word),
c AS (SELECT DISTINCT e.r, p FROM (SELECT r, p, i - unnest(range(6)) AS i FROM e) e JOIN u b ON b.r = e.r AND b.x = i JOIN u c ON c.r = e.r AND c.x = i + p WHERE b.six = c.six),
x AS (SELECT c.r, p, a.x AS k, a.word = b.word AS same FROM c JOIN u a ON a.r = c.r JOIN u b ON b.r = c.r AND b.x = a.x + p),
y AS (SELECT r, p, k - row_number() OVER (PARTITION BY r, p ORDER BY k) AS island, k FROM x WHERE same),
z AS (SELECT r, p, min(k) AS s, count(*) + p AS n FROM y GROUP BY r, p, island HAVING count(*) >= p AND count(*) + p >= 12),
m AS (SELECT r, s, n, min(p) AS p FROM z GROUP BY 1, 2, 3),
o AS (SELECT r, count(*) AS n_runs, first(struct_pack(s, n, p) ORDER BY n DESC, s, p) AS best, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM m GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(s + p, s + n)) AS x FROM m),
k AS (SELECT r, string_agg(word, ' ' ORDER BY u.x) FILTER (gone.x IS NULL) AS kept FROM u LEFT JOIN gone USING (r, x) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.p AS period, 1000 * best.n // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r) LEFT JOIN k USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3, "op6_decontamination": OP6, "op7_suffix_dedup": OP7, "op8_jaccard_join": OP8, "op9_chat_format": OP9, "op11_spelling_variants": OP11, "op12_substring_dedup": OP12, "op13_periodic_runs": OP13}
