"""A training-corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes the documents that the one before kept, is written as Parquet and read again. All but the last
return the columns of documents. What a stage decides takes effect: documents without a recognisable language go,
repeated lines are cut out of the texts (n_chars follows), one document of each near-duplicate component stays (its
smallest doc_id), contaminated documents go, and the rest are packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundflow.llm.common import drop, scratch, settled, table
from groundflow.llm.jaccard_join import jaccard_components
from groundflow.llm.language_id import fit, is_training, predict
from groundflow.llm.line_dedup import dedup_lines
from groundflow.llm.packing import pack
from groundflow.llm.positional_index import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised: not `und` and not ambiguous. Learned from the training rows alone."""
    with scratch():
        model = fit(docs.where(is_training()))
    found = predict(docs.select(COLUMNS), model)
    return found.where("lang_pred <> 'und' and not ambiguous").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines; a document all of whose lines repeat keeps an empty text."""
    found = dedup_lines(docs.select(COLUMNS))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component one document stays."""
    stays = jaccard_components(docs).where("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["doc_id"]), "left_semi").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("n_hit > 0").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Tokenization, learned classifiers and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows over the documents of sf_dir. A stage's tables go when its result is written, and that when the
    next one's is."""
    docs, before = table(spark, sf_dir, "documents").select(COLUMNS), None
    for name, stage in STAGES[:-1]:
        found = settled(spark, name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        docs = before = found
    return STAGES[-1][1](spark, docs, sf_dir)
