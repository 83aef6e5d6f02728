"""The corpus pipeline: language ID, line and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of ``documents``, and other columns that docs has.

Defined results: a null text, or one without a letter, has no language and goes in the first stage; the later
stages, given such rows, keep a null text null, treat it as empty, and keep one of the documents without words;
an empty text packs to the closing id alone; a null id sorts before all others and stays null; rows that
repeat an id and a text count as one document twice, of which near deduplication keeps one; an empty table
gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernix.llm import decontaminate, language, lines, packing, simhash
from quernix.llm.common import cut, discard, table, written


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated classifier rejects go."""
    return language.drop_rejected(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier line go from the texts, documents stay; n_chars follows (null for a null text)."""
    d = lines.dedup_lines(docs)
    return d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 1024 ids."""
    import public_tokenizers

    p = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return p.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Hash functions, a trained model and a tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on the way is deleted once the next table is written."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
