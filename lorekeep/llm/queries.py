"""The registered queries of the text operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, feistel_shards, graph_spans, host_paths, ngram_join, piece_encoding, quality_rules, syncmer_prints, toxicity_cnn, url_digests
from .common import table

#: Fixed values of the URL rules: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), **quality_files())


def quality_files() -> dict[str, str]:
    return {"piece_model": public_tokenizers.path("piece_bpe_32k.model"), "byte_ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(table(spark, sf_dir, "documents"), word_file())


def word_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op4_graph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graph_spans.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shard(table(spark, sf_dir, "documents"))


def op6_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(table(spark, sf_dir, "pages"))


def op7_syncmer_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_prints.fingerprints(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digests.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict:
    return {
        "op1_quality_fertility": op1_quality_fertility,
        "op2_piece_encoding": op2_piece_encoding,
        "op3_curve_packing": op3_curve_packing,
        "op4_graph_spans": op4_graph_spans,
        "op5_feistel_shards": op5_feistel_shards,
        "op6_host_paths": op6_host_paths,
        "op7_syncmer_prints": op7_syncmer_prints,
        "op8_ngram_join": op8_ngram_join,
        "op9_toxicity_cnn": op9_toxicity_cnn,
        "op10_url_digests": op10_url_digests,
    }


SQL = {
    "op4_graph_spans": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM words WHERE len(w) >= 35)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 35)))) AS places FROM windows WHERE h IN (SELECT h FROM twice) GROUP BY doc_id
), numbered AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words
), dead AS (
  SELECT doc_id, unnest(places) AS pos FROM gone
), kept AS (
  SELECT n.doc_id, string_agg(n.word, ' ' ORDER BY n.pos) AS text, count(*) AS k
  FROM numbered n ANTI JOIN dead d ON n.doc_id = d.doc_id AND n.pos = d.pos GROUP BY n.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.k, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
""",
    "op8_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * both_have >= 80 * (s.n + t.n - both_have)
), near AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(doc_id, to_id) AS (
  SELECT x, y FROM near UNION SELECT r.doc_id, n.y FROM reach r JOIN near n ON r.to_id = n.x
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.to_id), w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY w.doc_id, s.n
""",
    "op10_url_digests": r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END AS raw_host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
)
SELECT u.page_id, u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY ALL
""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
