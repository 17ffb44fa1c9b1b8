"""The operators' queries over the driver's tables, with SQL where SQL expresses the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import codes, decontamination, jaccard, licenses, mixing, negatives, pii, quality, sharding, tokenfiles, toxicity, urls, warc
from .util import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "the key of this query")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.sharded(table(spark, sf_dir, "documents"), n_shards=8)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, labelled=urls.page_labels(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.resolved(warc.records_of(table(spark, sf_dir, "pages")))
    header = lambda h: F.col("headers").getItem(h)
    return d.select("record_id", "canonical_url", "target_id", "outcome", "digest", header("etag").alias("etag"), header("server").alias("server"), header("expires").alias("expires"), F.size("headers").alias("n_headers"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenfiles.new_folder(spark)
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfiles.digests(spark, path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mined(rows, anchors=F.col("vec_id") % 50 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encoded(table(spark, sf_dir, "embeddings"), vector="embedding")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_url_filters": op4_url_filters,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scans": op7_license_scans,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CANONICAL = (
    "CASE WHEN url IS NOT NULL THEN regexp_replace(" + _LOW.format("regexp_extract(rest, '^([^/?]*)', 1)") + r""", '^(?:www|m)\.|:(?:80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END"""
)

_FLOORED = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _near(k: int) -> str:
    """n<k>: every part with its nearest entry of b<k>."""
    far = " + ".join(f"(x.{c} - b.{c}) * (x.{c} - b.{c})" for c in "abcd")
    return f"""n{k} AS (SELECT vec_id, label, p, a, b, c, d, e, far FROM (SELECT x.*, b.e, {far} AS far, row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY {far}, b.e) AS r FROM x JOIN b{k} b ON x.p = b.p) WHERE r = 1)"""


def _round(k: int) -> str:
    """n<k>, and b<k + 1>: the entries moved to the floors of their parts' means."""
    moved = ", ".join(f"coalesce(m.{c}, b.{c}) AS {c}" for c in "abcd")
    means = ", ".join(f"CAST(floor(sum({c}) / count(*)) AS BIGINT) AS {c}" for c in "abcd")
    return _near(k) + f""", b{k + 1} AS (SELECT b.p, b.e, {moved} FROM b{k} b LEFT JOIN (SELECT p, e, {means} FROM n{k} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


#: SQL for the operators whose whole result SQL expresses. Operators 1, 4, 8, 9 and 10 train, schedule or
#: sample, 2 and 3 walk keys and heaps, 11 runs a tokenizer: they are tested against brute force in tests/llm instead.
ORACLE: dict[str, str] = {
    "op5_warc": rf"""WITH src AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS dig, CASE WHEN page_id % 7 <> 0 THEN '"' || md5(coalesce(html, '')) || '"' END AS tag FROM pages),
  rest AS (SELECT *, regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS rest FROM src),
  parts AS (SELECT *, list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)=')) AS params FROM rest),
  c AS (SELECT p, dig, tag, {_CANONICAL} AS u FROM parts),
  rev AS (SELECT *, CASE WHEN p % 10 = 3 THEN '"changed"' ELSE tag END AS rtag, CASE WHEN p % 10 = 3 THEN -1 ELSE p END AS modified, 1700000000 + p * 60 + 86400 AS at FROM c),
  resp AS (SELECT p AS rp, dig AS rdig, tag AS ttag, u, 1700000000 + p * 60 AS at FROM c),
  j AS (SELECT r.*, t.rp, t.rdig, t.ttag FROM rev r ASOF LEFT JOIN resp t ON r.u = t.u AND r.at > t.at),
  o AS (SELECT *, CASE WHEN rp IS NULL THEN 'orphan' WHEN CASE WHEN rtag IS NOT NULL AND ttag IS NOT NULL THEN rtag = ttag ELSE modified = rp END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
  SELECT p * 2 + 1 AS record_id, u AS canonical_url, CASE WHEN outcome = 'resolved' THEN rp * 2 END AS target_id, outcome, CASE WHEN outcome = 'resolved' THEN rdig END AS digest,
    CASE WHEN outcome = 'resolved' THEN coalesce(rtag, ttag) ELSE rtag END AS etag, CASE WHEN outcome = 'resolved' THEN 'a' ELSE 'b' END AS server, '60' AS expires,
    CASE WHEN outcome = 'resolved' THEN 4 + (coalesce(rtag, ttag) IS NOT NULL)::INT ELSE 3 + (rtag IS NOT NULL)::INT END AS n_headers FROM o""",
    "op6_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
  g AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) END AS class_id FROM s),
  e AS (SELECT doc_id, unnest(s) AS x FROM s),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM shared JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach(a, b) AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
  SELECT doc_id, n::BIGINT AS n_shingles, class_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id, coalesce(k, 0) AS n_links
  FROM g LEFT JOIN (SELECT a, count(*) AS k FROM two GROUP BY a) l ON l.a = doc_id""",
    "op12_hard_negatives": f"""WITH k AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_FLOORED} AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
  s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s FROM k a JOIN k b ON a.id % 50 = 0 AND a.id <> b.id),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
  n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a WHERE NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
  SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3""",
    "op13_vector_codes": f"""WITH k AS (SELECT vec_id, label, {_FLOORED} AS q FROM embeddings WHERE {_USABLE}),
  x AS (SELECT vec_id, label, p, {", ".join(f"CAST(q[4 * p + {i + 1}] AS BIGINT) AS {c}" for i, c in enumerate("abcd"))} FROM k, (SELECT unnest(range(16)) AS p)),
  b0 AS (SELECT x.p, f.e, a, b, c, d FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64) f USING (vec_id)),
  {_round(0)}, {_round(1)}, {_near(2)},
  r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM n2 GROUP BY vec_id, label)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM r""",
}
