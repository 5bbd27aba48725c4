"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, html_text, packing, quality, secrets, sharding, simhash, substrings, topk, urls, word_queries
from .shared import table


def op1_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def _op2_sql(shards: int = 40, seed: int = 20240229) -> str:
    """The network and its cycle walking in plain arithmetic; checksums byte by byte, the table by its rule."""
    p = sharding.PRIME

    def once(source: str) -> str:
        q = f"SELECT row_no, n, a, b, v // b AS l, v % b AS r FROM {source}"
        for k in range(4):
            side, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            q = f"SELECT *, (({other} % {p}) * {sharding.ROUND_A[k]} + {seed % p} + {k}) % {p} AS t FROM ({q})"
            q = f"SELECT * REPLACE ((xor(t, t >> 15) * {sharding.ROUND_B[k]}) % {p} AS t) FROM ({q})"
            q = f"SELECT * EXCLUDE (t) REPLACE (({side} + xor(t, t >> 13)) % {size} AS {side}) FROM ({q})"
        return f"SELECT row_no, n, a, b, l * b + r AS v FROM ({q})"

    entry = "x"
    for _ in range(8):
        entry = f"(CASE WHEN ({entry}) & 1 = 1 THEN xor(({entry}) >> 1, 3988292384) ELSE ({entry}) >> 1 END)" if entry == "x" else f"list_transform([{entry}], lambda y: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)[1]"
    return f"""
WITH RECURSIVE crc AS (SELECT list({entry} ORDER BY x) AS entries FROM range(256) AS t(x)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, (length(h) // 2 + 16)::BIGINT AS size,
  xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM d, crc),
m AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n FROM s),
box AS (SELECT row_no, n, floor(sqrt(n - 1))::BIGINT + 1 AS a, row_no AS v FROM m),
sides AS (SELECT row_no, n, a, greatest(1, (n + a - 1) // a) AS b, v FROM box),
w AS ({once("sides")} UNION ALL {once("(SELECT * FROM w WHERE v >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INTEGER AS shard, v // {shards} AS slot, NULL::INTEGER AS grown_shard, m.row_no FROM m JOIN w ON w.row_no = m.row_no AND w.v < w.n
"""


OP2_SQL = _op2_sql()


def op3_simhash(spark, sf_dir):
    return simhash.group_documents(table(spark, sf_dir, "documents"))


def op4_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Every string of 200 bytes, in hexadecimal digits cut from blocks of 200 bytes, and the runs that those met twice cover.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n, list_transform(range(length(h) // 400 + 2), lambda j: h[400 * j + 1:400 * j + 400]) AS blocks FROM d),
w AS (SELECT r, unnest(range(n - 199)) AS i, unnest(list_transform(range(n - 199), lambda i: md5((blocks[i // 200 + 1] || blocks[i // 200 + 2])[2 * (i % 200) + 1:2 * (i % 200) + 400]))) AS k FROM n WHERE n >= 200),
often AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w SEMI JOIN often USING (k)),
marked AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM hit),
spans AS (SELECT r, span, min(i) AS a, max(i) + 200 AS b FROM marked GROUP BY r, span),
told AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda j: h[2 * (CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END) + 1:2 * (CASE WHEN j > n_spans THEN n ELSE starts[j] END)]), '') END)) AS kept_sha256
FROM n LEFT JOIN told USING (r)
"""


def op6_secret_scan(spark, sf_dir):
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    many = lambda kind: F.size(F.filter("secrets_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", many("assign"), many("access"), many("hex"), F.sha2(secrets.spans_text(F.col("secrets_base")), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans")
    )


def op8_url_filter(spark, sf_dir):
    """Outcomes: the quality label that carries the page's number. One suspicious host loses only what no rule allows."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), outcomes)


OP8_SQL = r"""
WITH page AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
marks AS (SELECT doc_id AS page_id, sum(quality)::BIGINT AS g, count(*) AS c FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sited AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS site FROM page),
counted AS (SELECT site, coalesce(sum(g), 0)::DOUBLE AS n_good, coalesce(sum(c), 0)::DOUBLE AS n_all, string_split(site, '.') AS ls FROM sited LEFT JOIN marks USING (page_id) GROUP BY site),
parts AS (SELECT *, array_to_string(ls[-2:], '.') AS two, array_to_string(ls[-3:], '.') AS three FROM counted),
known_takes AS (SELECT *, CASE WHEN regexp_full_match(site, '[0-9]{1,3}(\.[0-9]{1,3}){3}') OR site LIKE '[%' THEN 0
  WHEN regexp_full_match(two, '(com|co|net|ne|org|or|gov|gob|go|edu|ac|mil|nom)\.[a-z][a-z]') OR regexp_full_match(two, '(github|gitlab)\.io|(wordpress|blogspot|herokuapp)\.com|(netlify|vercel|web)\.app|pages\.dev') THEN 2 ELSE 1 END AS k FROM parts),
learnt AS (SELECT two FROM (SELECT two, three, count(*) AS c FROM known_takes WHERE k = 1 AND len(ls) > 2 GROUP BY two, three) GROUP BY two HAVING count(*) FILTER (c > 1) >= 16),
takes AS (SELECT * REPLACE (CASE WHEN k = 1 AND len(ls) > 2 AND two IN (SELECT two FROM learnt) THEN 2 ELSE k END AS k) FROM known_takes),
hosts AS (SELECT site AS host, n_good, n_all, CASE k WHEN 0 THEN site WHEN 2 THEN three ELSE two END AS domain, CASE k WHEN 0 THEN '' WHEN 2 THEN two ELSE ls[-1] END AS suffix FROM takes),
total AS (SELECT coalesce(sum(n_good) / nullif(sum(n_all), 0), 1.0) AS prior FROM hosts),
s0 AS (SELECT suffix, sum(n_good) AS good, sum(n_all) AS al, any_value(prior) AS prior FROM hosts, total GROUP BY suffix),
s1 AS (SELECT {fit} AS s FROM (SELECT *, greatest(0.001, least(0.999, prior)) AS m FROM s0)),
s2 AS (SELECT suffix, (good + s * prior) / (al + s) AS mean FROM s0, s1),
d0 AS (SELECT domain, hosts.suffix, sum(n_good) AS good, sum(n_all) AS al, any_value(s2.mean) AS prior FROM hosts JOIN s2 ON hosts.suffix = s2.suffix GROUP BY domain, hosts.suffix),
d1 AS (SELECT {fit} AS s FROM (SELECT *, greatest(0.001, least(0.999, prior)) AS m FROM d0)),
d2 AS (SELECT domain, (good + s * prior) / (al + s) AS mean FROM d0, d1),
h0 AS (SELECT host, n_good AS good, n_all AS al, d2.mean AS prior FROM hosts JOIN d2 ON hosts.domain = d2.domain),
h1 AS (SELECT {fit} AS s FROM (SELECT *, greatest(0.001, least(0.999, prior)) AS m FROM h0)),
h2 AS (SELECT host, (good + s * prior) / (al + s) AS rate, al + s AS weight FROM h0, h1),
known AS (SELECT host, round(rate, 9) AS rate, round(rate + 1.645 * sqrt(rate * (1 - rate) / (weight + 1)), 9) AS bound FROM h2),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM page) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, page.host, page.path, rule, coalesce(v, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, rate, bound
FROM sited AS page LEFT JOIN known ON page.site = known.host LEFT JOIN fits ON page.host = fits.host AND page.path = fits.path
""".replace("{fit}", "coalesce(CASE WHEN (sum((good - al * m) * (good - al * m) / (m * (1 - m))) - sum(al)) / nullif(sum(al * (al - 1)), 0) > 0 THEN greatest(2.0, least(200.0, 1 / ((sum((good - al * m) * (good - al * m) / (m * (1 - m))) - sum(al)) / nullif(sum(al * (al - 1)), 0)) - 1)) ELSE 200.0 END, 200.0)")


def _op6_sql() -> str:
    """The same spans in SQL: DuckDB's entropy aggregate over every window; its patterns need no look-behind, as runs are taken whole."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [(k, p.replace("(?<![0-9a-f])", "")) for k, p, _, _ in secrets.BASE] + [("entropy", secrets.CANDIDATE.partition(")")[2])]
    values = ", ".join(f"({r}, {quote(k)}, {quote(p)})" for r, (k, p) in enumerate(kinds))
    one = lambda p: f"NOT regexp_matches(word, {quote(p[1:])})" if p.startswith("!") else f"regexp_matches(word, {quote(p)})"
    allowed = " OR ".join("(" + " AND ".join(one(p) for p in ([a] if isinstance(a, str) else a)) + ")" for a in secrets.ALLOW)
    least = " ".join(f"WHEN regexp_matches(word, {quote(c)}) THEN {bits}" for c, bits in secrets.CLASSES)
    windows = "list_max(list_transform(range(1, length(word) - 18), lambda i: list_aggregate(string_split(substr(word, i, 20), ''), 'entropy')))"
    text = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){where}, '')"
    many = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH k(rank, kind, pat) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT r, rank, kind, pat, regexp_extract_all(x, pat) AS w, string_split_regex(x, pat) AS b FROM d, k WHERE regexp_matches(x, pat)),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM m),
p AS (SELECT r, rank, kind, pat, w[n] AS word, (list_sum(list_transform(b[1:n], lambda v: length(v))) + coalesce(list_sum(list_transform(w[1:n - 1], lambda v: length(v))), 0))::BIGINT AS s FROM i),
q AS (SELECT *, s + length(word) AS e FROM p WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(word, pat, 2)) >= 8 WHEN 'entropy' THEN NOT ({allowed}) AND {windows} >= CASE {least} END ELSE true END),
f AS (SELECT * FROM q WHERE kind <> 'entropy' OR NOT EXISTS (SELECT 1 FROM q AS o WHERE o.r = q.r AND o.kind <> 'entropy' AND o.s <= q.s AND q.e <= o.e))
SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM (
  SELECT d.r, any_value(doc_id) AS doc_id, {many}, sha256({text(" FILTER (kind <> 'entropy')")}) AS base_sha256, {text("")} AS spans FROM d LEFT JOIN f ON f.r = d.r GROUP BY d.r)
"""


OP6_SQL = _op6_sql()


def op7_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_topk(spark, sf_dir):
    return topk.top_k(topk.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = len(embedding)),
s AS (
  SELECT q.uid, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v AS q JOIN v ON q.uid <> v.uid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def word_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def queries():
    return {
        "op1_decontamination": op1_decontamination,
        "op2_sharding": op2_sharding,
        "op3_simhash": op3_simhash,
        "op4_html_text": op4_html_text,
        "op5_substrings": op5_substrings,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality": op7_quality,
        "op8_url_filter": op8_url_filter,
        "op9_topk": op9_topk,
        "op10_packing": op10_packing,
        **word_queries.QUERIES,
    }


def oracle_sql():
    return {"op2_sharding": OP2_SQL, "op5_substrings": OP5_SQL, "op6_secret_scan": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_topk": OP9_SQL, **word_queries.SQL}
