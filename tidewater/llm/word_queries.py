"""Registered queries over words and shingles (operators 11 to 13) and their SQL."""

from __future__ import annotations

from . import chosen_path, periodic, spelling
from .shared import table

#: Words of a text, and A-Z lower-cased, in DuckDB.
_SPLIT = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _entries() -> str:
    """The 256 entries of the CRC-32 table, by its rule."""
    entry = "x"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda y: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)[1]"
    return f"SELECT list({entry} ORDER BY x) AS entries FROM range(256) AS t(x)"


def _crc(text: str) -> str:
    """CRC-32 of a string, with the table in ``entries``."""
    return f"xor(4294967295, list_reduce(list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]), 4294967295::BIGINT))"


def op11_chosen_path(spark, sf_dir):
    return chosen_path.group_documents(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(text=_LOW.format(text="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t FROM w),
e AS (SELECT r, len(t) AS n, unnest(t) AS x FROM s),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e AS a JOIN e AS b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS other FROM s UNION SELECT reach.r, b FROM reach JOIN both_ways ON a = other),
low AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = other GROUP BY reach.r)
SELECT doc_id, len(t)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM s JOIN low ON s.r = low.r
"""


def op12_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.find_periodic(table(spark, sf_dir, "documents"), plant=True))


#: Lags at which three neighbouring multiples hold one word, then stretches of equal words at these lags alone.
OP12_SQL = f"""
WITH crc AS ({_entries()}),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS v, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc("doc_id::VARCHAR")} END AS h FROM documents, crc),
d1 AS (SELECT *, len(v) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM d1),
d AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: v[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM d2),
lags AS (SELECT r, n, w, unnest(range(1, n // 3 + 1)) AS q FROM d WHERE n >= 24),
held AS (SELECT r, n, w, q FROM lags WHERE len(list_filter(range((n - 1) // q - 1), lambda k: w[1 + k * q] = w[1 + (k + 1) * q] AND w[1 + k * q] = w[1 + (k + 2) * q])) > 0),
places AS (SELECT r, q, unnest(list_filter(range(n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM held),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM places),
found AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM found GROUP BY r, s, l),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM runs),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
drops AS (SELECT r, list(i) AS dropped FROM gone GROUP BY r),
texts AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN dropped IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(dropped, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN texts ON texts.r = d.r LEFT JOIN best ON best.r = d.r AND k = 1 LEFT JOIN drops ON drops.r = d.r
"""


def op13_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


#: Near words by patterns: one place left open, or one code point left out.
OP13_SQL = f"""
WITH RECURSIVE crc AS ({_entries()}),
t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOW.format(text="text")}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, run, count(*) AS k FROM t GROUP BY id, run),
h AS (SELECT run, k, {_crc("(id || ':' || run)")} AS h FROM c, crc),
f AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
words AS (SELECT word, sum(k)::BIGINT AS n FROM f WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
open AS (SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS p FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
short AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS p FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM open AS a JOIN open AS b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT words.word, words.n, short.word, short.n FROM short JOIN words ON short.p = words.word
  UNION ALL SELECT short.word, short.n, words.word, words.n FROM short JOIN words ON short.p = words.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
marks AS (SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM ranked WHERE k = 1),
steps AS (SELECT word, word AS root, 0 AS far FROM words UNION ALL SELECT steps.word, form, far + 1 FROM steps JOIN marks ON marks.word = root WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(root, far) AS root FROM steps GROUP BY word)
SELECT words.word, form, root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words LEFT JOIN marks ON marks.word = words.word JOIN ends ON ends.word = words.word
"""

QUERIES = {"op11_chosen_path": op11_chosen_path, "op12_periodic_runs": op12_periodic_runs, "op13_spelling_variants": op13_spelling_variants}
SQL = {"op11_chosen_path": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_spelling_variants": OP13_SQL}
