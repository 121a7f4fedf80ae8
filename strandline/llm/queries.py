"""The corpus operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import centroids, fingerprints, media, merkle, minhash, mixing, packing, quality, substring, topk, toxicity, urlfilter, warc
from strandline.llm.common import ascii_lower, give_back

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85).select("doc_id", "n_shingles", "component_id", "kept")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, sentences removed, and the documents that hold them first."""
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_sentences", "first_docs")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(topk.query_rows(vectors, 100)))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5, 0)
    texts, marks = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~out)
    return toxicity.score_texts(docs, toxicity.train(texts, marks)).select("doc_id", out.alias("held_out"), "score", "predicted")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.QualityModel:
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(*quality.labelled_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~out))
    give_back()  # the features went through the driver
    return model


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_texts(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.kept_vectors(table(spark, sf_dir, "embeddings"), 64), k=40, rounds=5, scale=256.0, seed="2:")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.verified_manifest(table(spark, sf_dir, "documents"), ascii_lower(F.col("text")), chosen)


def _levels_sql(name: str, by: str, levels: int, start: str) -> str:
    """Levels of trees over ``{name}0`` (by, i, n, h) and what each leaf of ``start`` (r, by, i, n, sib, f) meets on its way up."""
    steps, same = [], f"p.{by} IS NOT DISTINCT FROM q.{by}"
    for k in range(levels):
        steps.append(f"""{name}r{k} AS MATERIALIZED (SELECT {by}, i // 8 AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY {by}, i // 8
), {name}{k + 1} AS MATERIALIZED (SELECT {by}, i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k}
), {name}p{k + 1} AS MATERIALIZED (
  SELECT p.r, p.{by}, p.i // 8 AS i, (q.n + 7) // 8 AS n,
         CASE WHEN q.n > 1 THEN sib || array_to_string(hs[1:p.i % 8], '') || array_to_string(hs[p.i % 8 + 2:], '') ELSE sib END AS sib,
         CASE WHEN q.n > 1 THEN sha256(array_to_string(hs[1:p.i % 8], '') || f || array_to_string(hs[p.i % 8 + 2:], '')) ELSE f END AS f
  FROM {start if k == 0 else f"{name}p{k}"} p JOIN {name}r{k} q ON {same} AND p.i // 8 = q.i
)""")
    return ", ".join(steps)


def _leaf_sql(text: str) -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC_SQL = """xor(4294967295, list_reduce(range(0, 8 * length(CAST(doc_id AS VARCHAR))), lambda c, i: xor((CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1))) ELSE c END) >> 1,
       3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(CAST(doc_id AS VARCHAR), i // 8 + 1, 1))) ELSE c END) % 2)), 4294967295::BIGINT))"""


def _rounds_sql(rounds: int) -> str:
    """Assignments and means of each round, one after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d, row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) AS k FROM v, c{i} c
  ) WHERE k = 1
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (SELECT a{i}.c, t.i, CAST(sum(v.x[t.i]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY c
  ) m USING (c)
)""")
    return ", ".join(steps)


QUERIES = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_best_fit_packing": best_fit_packing,
    "op4_mix_sources": mix_sources,
    "op5_exact_top_k": exact_top_k,
    "op6_media_columns": media_columns,
    "op7_warc": warc_records,
    "op8_url_filters": url_filters,
    "op9_toxicity": toxicity_scores,
    "op10_quality": quality_scores,
    "op11_centroid_clusters": centroid_clusters,
    "op12_document_fingerprints": document_fingerprints,
    "op13_merkle_manifest": merkle_manifest,
}

ORACLE_SQL = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * met >= 85 * (x.n + y.n - met)
), e AS (
  SELECT u, v FROM l UNION SELECT v, u FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.d
)
SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id, d = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
""",
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op11_centroid_clusters": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(k - 1 AS INTEGER) AS c, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) AS k FROM v) WHERE k <= 40
), """
    + _rounds_sql(5)
    + """
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN v USING (r) JOIN c5 USING (c)
""",
    "op13_merkle_manifest": f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents
), s AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), l0 AS MATERIALIZED (SELECT lang, i, n, leaf AS h FROM s
), lp0 AS MATERIALIZED (SELECT r, lang, i, n, '' AS sib, coalesce(other, leaf) AS f FROM s
), {_levels_sql("l", "lang", 7, "lp0")}
, t0 AS MATERIALIZED (SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM l7
), tp0 AS MATERIALIZED (SELECT p.r, 0 AS one, t0.i, t0.n, p.sib, p.f FROM lp7 p JOIN t0 ON p.lang IS NOT DISTINCT FROM t0.lang
), {_levels_sql("t", "one", 4, "tp0")}
SELECT d.doc_id, d.leaf, l7.h AS subroot, t4.h AS root, sha256(p.sib) AS proof_sha256, p.f AS folded_root, p.f = t4.h AS verified
FROM d JOIN tp4 p USING (r) JOIN l7 ON l7.lang IS NOT DISTINCT FROM d.lang, t4
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM g
""",
    "op8_url_filters": """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), b AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1
""",
}
