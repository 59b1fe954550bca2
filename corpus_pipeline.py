"""A training corpus from raw documents, in five stages of the operators in tracksmith.llm.

Each stage takes (spark, docs, sf_dir); its result is written and read back as the next one's docs. All but the last return the
columns of documents; mixing adds size, source_size, target, copies (how often the mix takes the row, at least once) and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import Workspace
from tracksmith.llm.decontamination import drop_contaminated
from tracksmith.llm.line_dedup import dedup_lines
from tracksmith.llm.mixing import mix_to_targets
from tracksmith.llm.near_dedup import drop_near_duplicates
from tracksmith.llm.quality import score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of the raw table."""
    scored = score_quality(docs, _table(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go from the texts; a document with no word left goes. n_chars follows the text."""
    out = dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes at least once, with how often it does."""
    return mix_to_targets(docs).where("copies > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier and the hash thresholds have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = work.save(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            work.drop(docs)
        docs = new
    return docs
