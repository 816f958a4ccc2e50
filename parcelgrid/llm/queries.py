"""One query for each operator, over its whole table with the parameters meant for production."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.llm import (decontamination, extraction, fingerprints, fixity, packing, parity_join, periodic_runs, pii, sharding, suffix_dedup,
                            suffix_lm, toxicity, whitening)
from parcelgrid.llm.common import table


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file())


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def replica(pages: DataFrame) -> DataFrame:
    """A copy of `pages` with some records lost and some changed."""
    return (pages.filter("page_id is null or page_id % 211 <> 7")
            .withColumn("html", F.when(F.expr("page_id % 97 = 5"), F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, replica(pages))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("removed")


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(table(spark, sf_dir, "documents"), edit=periodic_runs.looped))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_tree_lm, op3_decontamination, op4_warc_fixity, op5_suffix_array_dedup,
                                   op6_minhash_fingerprints, op7_personal_data, op8_toxicity, op9_feistel_shards, op10_parity_join,
                                   op11_periodic_runs, op12_whitening, op13_main_text, pipeline)}

ORACLES = {
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
            FROM benchmark WHERE item_id IS NOT NULL)),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, spots.n, i FROM spots JOIN win ON spots.t = win.t AND spots.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op4_warc_fixity": r"""
WITH a AS (SELECT page_id, page_id // 1024 AS file_no, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <page:',
  page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ') AS head, coalesce(html, '') AS html FROM pages),
rec AS (SELECT 1 AS copy, page_id, file_no, head, html FROM a
        UNION ALL SELECT 2, page_id, file_no, head, CASE WHEN page_id % 97 = 5 THEN concat(html, '~') ELSE html END FROM a WHERE page_id % 211 <> 7),
full_ AS (SELECT copy, page_id, file_no, concat(head, strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS r FROM rec),
o AS (SELECT copy, page_id, file_no, sha256(r) AS digest, strlen(r) AS length,
      CAST(sum(strlen(r)) OVER (PARTITION BY copy, file_no ORDER BY page_id) - strlen(r) AS BIGINT) AS "offset" FROM full_)
SELECT x.page_id, CASE WHEN y.page_id IS NULL THEN 'missing' ELSE 'changed' END AS kind, x.file_no, x."offset", x.length, x.digest,
       y."offset" AS replica_offset, y.length AS replica_length, y.digest AS replica_digest
FROM (SELECT * FROM o WHERE copy = 1) x LEFT JOIN (SELECT * FROM o WHERE copy = 2) y USING (page_id)
WHERE y.digest IS NULL OR x.digest <> y.digest
""",
    # The rows to be found where a page marks its article by an element: what lies within, without markup.
    "op13_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') AS body FROM pages),
parts AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(regexp_replace(body, '<br[^>]*>', ' ', 'g'), '</?(p|h[1-6]|div|li|ul|ol)(\s[^>]*)?>'),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                                                '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS kept FROM a)
SELECT page_id, url, coalesce(array_to_string(kept, chr(10) || chr(10)), '') AS text, CAST(length(coalesce(array_to_string(kept, chr(10) || chr(10)), '')) AS BIGINT) AS n_chars
FROM parts
""",
}
