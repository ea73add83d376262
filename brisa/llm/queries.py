"""Registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brisa.llm import language as op8, line_dedup as op3, merkle as op5, mixing as op2, ngram_join as op7, periodic_runs as op12, pseudonyms as op6, sentencepiece_fst as op1, token_counts as op10, token_files as op11, vector_links as op9, warc as op4, whitening as op13
from brisa.llm.common import table

QUERIES, ORACLE = {}, {}
#: Keys the permutation of the registered query; a real run passes a secret of its own.
PSEUDONYM_KEY = "registered-query"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(sql="""
WITH s AS (SELECT source, count(*)::DOUBLE AS size FROM documents GROUP BY source),
     r AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
     u AS (SELECT d.*, rate, (('0x' || substr(md5('mix:' || doc_id || ':0'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
           FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
     p AS (SELECT source, list(p ORDER BY k) AS below FROM (
               SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
               FROM r, range(0, 81) AS t(k)) GROUP BY source),
     n AS (SELECT u.*, len(list_filter(below, lambda x: x < u)) AS n FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source),
     c AS (SELECT *, unnest(range(1, n + 1))::INT AS mix_copy FROM n)
SELECT doc_id, text, lang, source, n_chars, mix_copy, round(rate, 9) AS mix_rate, md5('mix/order:' || doc_id || ':' || mix_copy) AS mix_key FROM c""")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op2.mix(table(spark, sf_dir, "documents"), temperature=0.5, budget=1.0, seed="mix")
    return mixed.withColumn("mix_rate", F.round("mix_rate", 9))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.without_repeated_lines(table(spark, sf_dir, "documents"), num=80, den=100, least_words=1, runs=True)


@query(sql="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
     o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, owner, list_transform([1, 11, 21, 31], lambda x: ('0x' || substr(p.h, x, 10))::BIGINT) AS v
           FROM p JOIN o ON p.h = o.h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(flatten(list_transform(v, lambda y: list_transform([35, 30, 25, 20, 15, 10, 5, 0],
           lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> k) & 31)::INT + 1, 1)))), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to, true AS verified
FROM d""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.edited_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.pseudonymise(table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)


@query(sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.m AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id""")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.ngram_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query()
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.identify(table(spark, sf_dir, "documents"))


@query(sql="""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  m AS (SELECT a, min(b) AS m FROM r GROUP BY a), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT m.a AS vec_id, coalesce(k, 0)::BIGINT AS n_links, m.m AS component_id, m.a = m.m AS kept FROM m LEFT JOIN k ON k.a = m.a""")
def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.vector_links(table(spark, sf_dir, "embeddings"), least=0.98)


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, keys = op11.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return files.documents(keys).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12.periodic_runs(op12.with_planted_runs(table(spark, sf_dir, "documents")), least=6)
    best = found.withColumn("best", op12.most_repeated(F.col("runs")))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                       F.sha2(op12.written(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.whitened(table(spark, sf_dir, "embeddings"), components=16)
