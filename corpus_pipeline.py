"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it
returns is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``. Counted as part of ``citeloom.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import cube_mix, fm_quality, hist_pack, jaccard_join, line_dedup
from citeloom.llm.queries import TOKENIZER
from citeloom.llm.shared import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects (score under 0.5) go."""
    machine = fm_quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return fm_quality.score(docs, machine).where("predicted = 1").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in the one with the largest id; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles the least id stays."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced sample of its source takes it (0 to 3 times)."""
    out = cube_mix.mix_sources(docs)
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with the crc32 of their ids."""
    # executors still hold what the stages before needed, so little is encoded at once
    out = hist_pack.pack(docs, TOKENIZER, portion_bytes=1 << 20, cached_words=60_000)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Scores, sampling and tokenizers have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
