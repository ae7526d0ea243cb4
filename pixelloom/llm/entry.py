"""The registered queries of this subpackage: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bitplane, cover_tree, decontam, langid, maxent, minhash, negatives, packing, periodic, secrets, sharding, toxicity, warc
from pixelloom.llm.common import table


def op1_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' records against a replica with known damage."""
    pages = table(spark, sf_dir, "pages")
    return warc.audit(warc.records(pages), warc.damaged(pages))


OP2_SQL = """
with r as (
  select page_id, cast(floor(page_id / 256.0) as bigint) as segment,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages),
s as (select *, strlen(record) as size, row_number() over (partition by segment order by page_id) - 1 as seq,
    sum(strlen(record)) over (partition by segment order by page_id) - strlen(record) as record_offset from r),
d as (select *, sha256(record_offset::bigint || ':' || size || ':' || sha256(record)) as digest_a,
    sha256(record_offset::bigint || ':' || size || ':' || sha256('WARC/1.1' || substr(record, 9))) as digest_bad from s)
select segment, seq, page_id, record_offset::bigint as record_offset, size, case when page_id % 389 = 7 then 'missing' else 'corrupt' end as status, digest_a,
  case when page_id % 389 = 7 then null else digest_bad end as digest_b
from d where page_id % 389 = 7 or page_id % 97 = 5
"""


def op3_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bitplane.write_planes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return bitplane.read_planes(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(table(spark, sf_dir, "documents"))


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "item_windows", "share", "slots")


def op9_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), 8)


def op12_distance_key_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_cover_tree_links, op2_warc_merkle_audit, op3_bitplane_tokens, op4_hashed_maxent, op5_randomness_secrets, op6_naive_bayes_language, op7_cost_balanced_packing, op8_template_decontamination, op9_kneser_ney_toxicity, op10_probminhash_dedup, op11_external_shuffle, op12_distance_key_negatives, op13_suffix_tree_runs)}


def oracle_sql() -> dict:
    return {"op2_warc_merkle_audit": OP2_SQL}
