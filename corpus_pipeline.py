"""From raw documents to packed training sequences.

Every stage takes all rows its predecessor kept, whole, and is written as
Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.mixing import temperature_mix
from quillspark.llm.ngram_join import one_per_class
from quillspark.llm.packing import pack_documents
from quillspark.llm.toxicity import ACCEPT, train, training_rows, with_scores
from quillspark.scratch import materialize
from quillspark.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the accepted toxicity."""
    model = train(*training_rows(docs, table(spark, sf_dir, "labels")))
    return with_scores(docs, model).where(F.col("tx_score") < ACCEPT).drop("tx_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that stays."""
    return exact_dedup(docs).where("dd_kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix has them: each once at least, none over the repetition limit."""
    return temperature_mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the MinHash join or the packing.
ORACLE_SQL = None
