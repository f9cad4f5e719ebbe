"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binslack, chat, divergence, embeddings, fingerprint, hardneg, html_text, langid, mixing, neardup, packing, ppm, warc
from .common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with up to four variants each: every eighth component larger by half, or (a farther one) with its sign changed."""
    x, j = F.col("embedding"), F.col("j")
    factor = lambda i: F.when((j == 0) | (i % 8 != j), 1.0).when(j == 4, -1.0).otherwise(1.5)
    rows = table(spark, sf_dir, "embeddings").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 5)))
    return rows.select((F.col("vec_id") * 8 + j).alias("vec_id"), F.transform(x, lambda v, i: v.cast("double") * factor(i)).alias("embedding"))


def op6_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over vectors that have variants, so that there are links on any input."""
    return embeddings.near_duplicates(_families(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_binslack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, placed = binslack.pack(table(spark, sf_dir, "documents"))
    # Checksums before the join, so that ids are not shuffled.
    digests = cut.select("piece_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(placed, "piece_id").drop("piece_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor; labels of every seventh are changed first."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", changed), F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_chat, op2_ppm, op3_langid, op4_html, op5_fingerprints, op6_embeddings, op6_families, op7_mixing, op8_warc, op9_packing, op10_neardup]
    own += [op11_binslack, op12_hard_negatives, op13_divergence]
    return {f.__name__: f for f in own}


_WORD = r"[^\x20\x09-\x0D]+"

OP1_SQL = f"""
WITH m AS (
  SELECT conv_id, coalesce(floor(turn / {chat.PART_TURNS}), -1)::BIGINT AS part, turn::BIGINT AS turn,
         regexp_replace(coalesce(role, 'unknown'), '[<>|:\\r\\n]', '_', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
p AS (SELECT m.*, speaker, m.role = speaker AS mine, CASE WHEN m.role = speaker THEN '<|assistant|>' || chr(10) WHEN m.role = 'system' THEN '<|system|>' || chr(10)
             ELSE '<|user:' || m.role || '|>' || chr(10) END AS head, body || '<|end|>' AS tail
      FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
a AS (SELECT *, coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, body
                                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS b FROM p)
SELECT conv_id, speaker, part, count(*)::BIGINT AS n_messages, string_agg(head || tail || chr(10), '' ORDER BY turn NULLS LAST, role, body) AS text,
       coalesce(string_agg(CASE WHEN mine THEN b || ':' || (b + length(tail)) END, ',' ORDER BY turn NULLS LAST, role, body), '') AS spans,
       coalesce(sum(CASE WHEN mine THEN length(tail) END), 0)::BIGINT AS target_chars
FROM a GROUP BY conv_id, speaker, part
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
r(id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.to_id = p.a),
c AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

OP6_FAMILIES_SQL = OP6_SQL.replace(
    "WITH RECURSIVE v",
    """WITH RECURSIVE f AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, vec_id % 5 + 1)) AS j FROM embeddings),
embedded AS (SELECT vec_id * 8 + j AS vec_id,
  list_transform(e, lambda x, i: x * CASE WHEN j = 0 OR (i - 1) % 8 <> j THEN 1.0 WHEN j = 4 THEN -1.0 ELSE 1.5 END) AS embedding FROM f),
v""",
).replace("FROM embeddings WHERE len", "FROM embedded WHERE len").replace("FROM embeddings UNION", "FROM embedded UNION")

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
             (source_size * 3)::DOUBLE AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM w),
l AS (SELECT min_by((total - clamped) / open, cap / w) FILTER ((total - clamped) / open <= cap / w) AS level FROM c),
t AS (SELECT source, source_size, least(cap, w * coalesce(level, cap / w)) AS target FROM w, l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, (round(target) - whole * source_size)::BIGINT AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h % {mixing.BINS}, h, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""

OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL::VARCHAR AS error
FROM f
"""


OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a),
c AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{divergence.TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op6_embeddings": OP6_SQL, "op7_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op10_neardup": OP10_SQL} | {
        "op6_families": OP6_FAMILIES_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_divergence": OP13_SQL,
    }
