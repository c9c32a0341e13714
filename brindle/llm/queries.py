"""The operators bound to the tables of the test data, and the SQL that some can be checked with.

Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import decontaminate, extraction, langid, ngram_join, packing, quality, sharding, token_codes, urlfilter, warc
from .common import shared_dir, shipped, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
TOKENIZER = "byte_bpe_50k.json"
SHARDS = {f"shard-{i:03d}": 1.0 for i in range(64)}


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-codes")
    token_codes.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), end_id=0)
    return token_codes.read_token_files(spark, folder).drop("file")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


_ALL = {
    "op1_warc": op1_warc,
    "op2_sharding": op2_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_codes": op5_token_codes,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_extraction": op10_extraction,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: shipped(query) for name, query in _ALL.items()}

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
          list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM m""",
    "op3_url_filter": """
        WITH u AS (
          SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        v AS (
          SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
          ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
        FROM v LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id, host, path""",
}
