"""From raw documents to packed windows: five stages, each over all that its predecessor kept.

Toxic documents go, repeated lines are removed, one document of each group of near copies stays,
documents that hold benchmark passages go, and the rest is tokenised and packed.

Defined cases: a row is judged by its own text in every stage, so null and repeated ids lose nothing that
is clean; a null text has no lines, shingles or words, stays, and is packed as its end id alone; rows that
repeat id and text are handled alike, and near_dedup keeps all rows of a kept document; a document that
loses all lines stays with an empty text; an empty table gives empty tables and no windows; further
columns, whatever their names, stay up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dakspark.llm import decontam, linededup, minhash, packing, toxicity
from dakspark.llm.common import cut, read_table, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The network learns from the labelled documents and rejects those it finds toxic."""
    clean = toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    release(spark)
    return clean


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first in the corpus stays."""
    return linededup.dedupe_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more: the smallest id of a group stays."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 ids, with their ids and the ids' checksum."""
    return packing.pack_query(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Trained models, similarity joins and a tokenizer can't be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each one's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
