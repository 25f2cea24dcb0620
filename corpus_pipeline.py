"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import queries as q
from quarry.llm._tables import kept
from quarry.llm.line_crf import fit, keep_good
from quarry.llm.line_spread import cleaned
from quarry.llm.near_copies import keep_one
from quarry.llm.packing import pack
from quarry.llm.string_tiling import uncontaminated

#: SQL can't express the classifier, the fingerprints, the tiling or the packing; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores under the cut go."""
    model = fit(docs, q.table(spark, sf_dir, "labels"))
    return keep_good(docs, model, q.QUALITY_CUT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten sites or more go; every document stays, with n_chars counted anew where its text changed."""
    return cleaned(docs, min_sites=10)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: groups are linked where the sets of distinct five-word shingles have a similarity of 0.8 or more."""
    return keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a test item or more go."""
    return uncontaminated(docs, q.table(spark, sf_dir, "benchmark"), shortest=5, coverage=0.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 ids."""
    return pack(docs, q.vocabulary("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
