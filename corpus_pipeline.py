"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last keep the columns of ``documents``; ``n_chars`` stays what it was in the
source.  Rows with a null id pass the filters that need an id.
"""

from __future__ import annotations

from contentfit.llm.chunk_dedup import remove_repeats
from contentfit.llm.common import table, write_stage
from contentfit.llm.decontaminate import drop_contaminated
from contentfit.llm.near_dup import drop_near_duplicates
from contentfit.llm.packing import pack
from contentfit.llm.rule_quality import drop_low_quality


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: five-word shingles at
    0.8 (the four words of ``op5_near_dedup`` are that query's own)."""
    return drop_near_duplicates(docs, k=5)


def substring_dedup(spark, docs, sf_dir):
    """Passages that an earlier document has are cut from the text."""
    return remove_repeats(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """What is left, packed into sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are part of it


def run(spark, sf_dir):
    """The stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return docs
