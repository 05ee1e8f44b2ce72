"""Queries of this subpackage: each applies one operator, with its production
parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentfit.llm.chunk_dedup import repeated_spans
from contentfit.llm.common import table
from contentfit.llm.decontaminate import contained_items
from contentfit.llm.edit_counts import count_edited
from contentfit.llm.hard_negatives import hard_negatives
from contentfit.llm.language import identify
from contentfit.llm.line_quality import quality_rules
from contentfit.llm.near_dup import near_duplicates
from contentfit.llm.packing import pack
from contentfit.llm.rule_quality import quality
from contentfit.llm.sharding import assign_shards
from contentfit.llm.toxicity import toxicity
from contentfit.llm.vector_codes import compress_vectors
from contentfit.llm.warc import round_trip


def op1_toxicity(spark, sf_dir):
    """Toxicity scores of ``documents``, learned from ``labels.toxic``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark, sf_dir):
    """Token counts of ``documents`` before and after masking e-mail addresses and long numbers."""
    return count_edited(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    """``pages`` written to Zstandard WARC archives and read back."""
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op4_quality(spark, sf_dir):
    """Quality scores of ``documents``, learned from ``labels.quality``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark, sf_dir):
    """Near-duplicate components of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op6_substring_dedup(spark, sf_dir):
    """Passages of ``documents`` that an earlier document has, one row per document that loses words."""
    return repeated_spans(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    """Benchmark items contained in ``documents``."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark, sf_dir):
    """Base counts and line-frequency verdict of ``documents``, with ``source`` as host."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    """Languages of ``documents``."""
    return identify(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    """``documents`` packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    """``documents`` in 40 contiguous shards of near equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op12_vector_codes(spark, sf_dir):
    """``embeddings`` as codes of four codebooks of 256 entries."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth row of ``embeddings``, some labels moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}
