"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontamination, line_dedup, minhash, piece_codec, quality
from quillstack.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but the rows whose doc_id is in ids; rows without an id stay."""
    # a merge join at every size: ids grow with the documents, and so must not be broadcast
    return docs.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return without(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("not accepted"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; documents of which nothing else is left go."""
    out = line_dedup.drop_duplicate_lines(docs.select(*COLUMNS), min_equal=1)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id."""
    return without(docs, minhash.near_duplicates(docs).where("not kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    import public_tokenizers

    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Language models, edit distances and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
