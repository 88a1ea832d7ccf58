"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import audit, bpe, html, licences, minhash, mixing, negatives, quality, secrets, simhash, topk, toxicity, urls
from scriptorium.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_mixing, op3_secrets, op4_bpe, op5_minhash, op6_licences, op7_html, op8_topk, op9_quality, op10_urls, op11_audit, op12_negatives, op13_simhash)
    return {f.__name__: f for f in found}


OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(rank % 3 + 1)::INT]::BIGINT AS weight FROM ranked
), filling AS (
  SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS heavy, row_number() OVER (ORDER BY source_size / weight, rank) AS nth
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT min(nth) AS nth, arg_min(rest, nth) AS rest, arg_min(heavy, nth) AS heavy FROM filling WHERE rest * weight < 200 * source_size * heavy
), goals AS (
  SELECT f.source, f.source_size, CASE WHEN c.nth IS NULL OR f.nth < c.nth THEN (2 * f.source_size)::DOUBLE ELSE (f.weight * c.rest)::DOUBLE / (100 * c.heavy)::DOUBLE END AS target
  FROM filling f CROSS JOIN cut c
), placed AS (
  SELECT s.*, g.source_size, g.target, floor(g.target)::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY mark, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (least(greatest(whole - start, 0), size) + least(greatest(whole - start - source_size, 0), size))::BIGINT AS taken,
  (CASE WHEN size = 0 THEN 0 ELSE (start < whole)::INT + (start + source_size < whole)::INT END)::INT AS n_copies
FROM placed
"""

_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]+", 0),
    ("hex", "[0-9a-f]{32,}", 0),
    ("login", r"(?i:(user|username|login|account|client_id))\x20*[:=]\x20*[A-Za-z0-9_.@-]+", 0),
    ("key40", "[A-Za-z0-9/+]{40,}", 0),
    ("endpoint", r"[a-z]+://[A-Za-z0-9.-]+|[A-Za-z0-9-]+\.amazonaws\.com", 0),
)


def _op3() -> str:
    each = " UNION ALL ".join(
        f"SELECT nr, {i} AS i, '{kind}' AS kind, unnest(regexp_split_to_array(t, '{p}')[:-2]) AS gap, unnest(regexp_extract_all(t, '{p}', 0)) AS found, unnest(regexp_extract_all(t, '{p}', {g})) AS part, generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) AS k FROM rows"
        for i, (kind, p, g) in enumerate(_KINDS)
    )
    return rf"""
WITH rows AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({each}),
spans AS (
  SELECT nr, i, kind, part, (sum(length(gap) + length(found)) OVER w)::BIGINT AS stop, (sum(length(gap) + length(found)) OVER w - length(found))::BIGINT AS start
  FROM matches WINDOW w AS (PARTITION BY nr, i ORDER BY k)
),
standing AS (
  SELECT *, CASE WHEN kind IN ('access', 'login') THEN 'id' WHEN kind = 'endpoint' THEN 'end' ELSE 'secret' END AS role FROM spans
  WHERE CASE kind WHEN 'assign' THEN length(part) >= 8 WHEN 'access' THEN length(part) >= 16 WHEN 'key40' THEN length(part) = 40 ELSE true END
),
near AS (
  SELECT s.nr, s.kind, s.start, list(DISTINCT c.role) AS roles FROM standing s JOIN standing c ON c.nr = s.nr AND c.start BETWEEN s.start - 1024 AND s.start + 1024
  WHERE s.i > 2 GROUP BY ALL
),
kept AS (
  SELECT s.* FROM standing s LEFT JOIN near n USING (nr, kind, start) WHERE s.i < 3
    OR list_has_all(n.roles, CASE s.kind WHEN 'login' THEN ['secret', 'end'] WHEN 'key40' THEN ['id'] ELSE ['secret', 'id'] END)
),
summed AS (
  SELECT nr, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, i) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, i) FILTER (i < 3) AS base,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _KINDS)}
  FROM kept GROUP BY nr
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in _KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN summed USING (nr)
"""


OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * p.n >= 85 * (s.n + t.n - p.n)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)
"""

OP8 = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


OP11 = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), masks AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM worded
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false)::INT AS good, coalesce(bool_or(toxic = 1), false)::INT AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT c, (1 << i)::INT AS bit FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) v(c, i)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[:s - 1]), 0)::INT AS earlier FROM orders, generate_series(1, 5) g(s)
), found AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
"""

OP12 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10
"""

OP13 = r"""
WITH placed AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS nr, doc_id, coalesce(text, '') AS t FROM documents
), followed AS (
  SELECT nr, doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY nr), first_value(t) OVER (ORDER BY nr)) AS next FROM placed
), changes AS (
  SELECT nr, doc_id, n, t, substr(t, 1, n - n // 2) || substr(next, 1, n // 2) AS changed FROM followed
), texts AS (
  SELECT nr, 0 AS kind, t FROM changes UNION ALL SELECT nr, 1, changed FROM changes
), words AS (
  SELECT DISTINCT nr, kind, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word FROM texts
), votes AS (
  SELECT nr, kind, length(bin(length(word))) AS weight, ('0x' || md5(word)[1:16])::UBIGINT AS hi, ('0x' || md5(word)[17:32])::UBIGINT AS lo FROM words
), summed AS (
  SELECT nr, kind, {sums}, sum(weight) AS total FROM votes GROUP BY nr, kind
), signs AS (
  SELECT nr, kind, {signs} FROM summed
), prints AS (
  SELECT b.nr, b.doc_id, b.n, sha256(b.changed) AS edited_sha256, coalesce(x.f, repeat('0', 128)) AS f, coalesce(y.f, repeat('0', 128)) AS e
  FROM changes b LEFT JOIN signs x ON x.nr = b.nr AND x.kind = 0 LEFT JOIN signs y ON y.nr = b.nr AND y.kind = 1
), nexts AS (
  SELECT *, coalesce(lead(f) OVER (ORDER BY nr), first_value(f) OVER (ORDER BY nr)) AS g FROM prints
), own AS (
  SELECT f, count(*) AS n, min(doc_id) AS least FROM prints GROUP BY f
), near AS (
  SELECT a.f, sum(b.n) - 1 AS n_near, min(b.least) AS near_id FROM own a JOIN own b ON bit_count(xor(a.f::BIT, b.f::BIT)) <= 6 GROUP BY a.f
)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, {fp} AS fingerprint, {ep} AS edited_fingerprint,
  1 - bit_count(xor(f::BIT, e::BIT)) / 128.0::DOUBLE AS near_edited, 1 - bit_count(xor(f::BIT, g::BIT)) / 128.0::DOUBLE AS near_next, n_near::BIGINT AS n_near, near_id
FROM nexts JOIN near USING (f)
"""


def _op13() -> str:
    halves = [(half, 63 - j) for half in ("hi", "lo") for j in range(64)]
    hexed = lambda c: " || ".join(f"printf('%016x', {c}[{64 * i + 1}:{64 * i + 64}]::BIT::BIGINT)" for i in range(2))
    return OP13.format(
        sums=", ".join(f"sum(weight) FILTER ((({half} >> {j}) & 1) = 1) AS {half}{j}" for half, j in halves),
        signs=" || ".join(f"CASE WHEN 2 * {half}{j} > total THEN '1' ELSE '0' END" for half, j in halves) + " AS f",
        fp=hexed("f"),
        ep=hexed("e"),
    )


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op3_secrets": _op3(), "op5_minhash": OP5, "op8_topk": OP8, "op11_audit": OP11, "op12_negatives": OP12, "op13_simhash": _op13()}
