"""The registered query of each operator: production parameters, whole tables, whole results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir
from . import centroids, decontaminate, html_text, langid, minhash, mixing, phrases, pii, quality, search, simhash, urls, warc
from .common import bounded_sample, fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, queries, k=10)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_entities")


#: Labelled rows that the quality classifier is fitted on, at most.
OP3_ROWS = 8000


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.coalesce(fold_of(c, 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    some = F.broadcast(bounded_sample(labels, F.col("doc_id"), OP3_ROWS))
    model = quality.fit(docs.select("doc_id", "text", "n_chars").join(some, "doc_id"), OP3_ROWS)
    return quality.score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a crawler's WARC files, read back, and what is derived from these."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.responses_from_pages(table(spark, sf_dir, "pages")), path)
    made = warc.derive(warc.read(spark, path))
    source = lambda k: F.try_element_at(F.col("headers"), F.lit(k))
    return made.select(
        source("WARC-Page-ID").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest",
        source("WARC-Source-Block-Digest").alias("source_block_digest"), source("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.length("block").alias("content_length"), F.col("block").cast("string").alias("content"),
    )


#: The rules of op5_url_filter; the URLs that they decide are what its trees learn from.
OP5_RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"), urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, OP5_RULES, urls.fit(urls.labelled_by(OP5_RULES, pages)))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


#: What op11_minhash_near_dedup gives: all pairs of different sets that share a shingle, then the least id within reach.
OP11_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM cut),
nodes AS (SELECT md5(array_to_string(s, '|')) AS node, any_value(s) AS s, any_value(len(s)) AS n, MIN(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY 1),
each AS (SELECT node, n, unnest(s) AS g FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.g = b.g AND a.node <> b.node AND 100 * LEAST(a.n, b.n) >= 85 * GREATEST(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * COUNT(*) >= 85 * (any_value(a.n) + any_value(b.n) - COUNT(*))),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT r.node, MIN(n.first) AS component_id FROM reach r JOIN nodes n ON n.node = r.other GROUP BY r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id,
       s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS kept
FROM sets s LEFT JOIN least l ON l.node = md5(array_to_string(s.s, '|'))
"""


#: What op12_phrase_collocations gives: every phrase of one to five words counted.
OP12_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut, range(1, 6) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, COUNT(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
held AS (SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, f FROM often WHERE k > 2),
closed AS (SELECT * FROM often o WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = o.lang AND h.phrase = o.phrase AND 100 * h.f >= 100 * o.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score, j
  FROM closed c JOIN totals t ON t.lang = c.lang, range(1, 5) s(j), often x, often y
  WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best QUALIFY rank <= 2000
"""


def _op13_sql(rounds: int = 3) -> str:
    """Every vector against every centroid, three rounds and a last assignment."""
    near = """SELECT vec_id, place, v, c.k AS cluster, list_sum(list_transform(list_zip(v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM kept, c{0} c QUALIFY ROW_NUMBER() OVER (PARTITION BY place ORDER BY d, cluster) = 1"""
    parts = ["""WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, ROW_NUMBER() OVER () AS place FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (SELECT * FROM whole),
c0 AS MATERIALIZED (SELECT (ROW_NUMBER() OVER (ORDER BY sha256('1:' || COALESCE(vec_id::VARCHAR, '')), v) - 1)::INT AS k, v AS c FROM kept QUALIFY k < 16)"""]
    for i in range(rounds):
        parts.append(f"a{i} AS ({near.format(i)})")
        parts.append(f"s{i} AS (SELECT cluster, j, SUM(v[j])::BIGINT AS x, COUNT(*) AS n FROM a{i}, range(1, 65) r(j) GROUP BY ALL)")
        parts.append(f"m{i} AS (SELECT cluster, list((x - ((x % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY cluster)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, COALESCE(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.k)")
    parts.append(f"a{rounds} AS ({near.format(rounds)})")
    return ",\n".join(parts) + f"""
SELECT vec_id, cluster, d AS distance, SUM(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, SUM(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.cluster"""


#: What op6_mix_sources gives: sources, water level, then each source's documents in the order of their key.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('11:' || COALESCE(doc_id::VARCHAR, '-')) AS k
  FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
able AS (
  SELECT *, 3 * source_size AS cap, (SELECT SUM(source_size) FROM sources)::BIGINT AS total
  FROM sources WHERE source_size > 0),
levels AS (
  SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
  FROM able),
water AS (SELECT arg_min(level, cap / w) AS water FROM levels WHERE level * w <= cap),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.source_size = 0 THEN 0.0 WHEN water * s.w > 3 * s.source_size OR water IS NULL THEN (3 * s.source_size)::DOUBLE ELSE water * s.w END AS target
  FROM sources s CROSS JOIN water),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1))::BIGINT AS whole,
         SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN run - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_topk": op1_bm25_topk,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_fm": op3_quality_fm,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_url_filter": op5_url_filter,
    "op6_mix_sources": op6_mix_sources,
    "op7_html_main_text": op7_html_main_text,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {"op6_mix_sources": OP6_SQL, "op11_minhash_near_dedup": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
