"""A training corpus from raw documents: five stages, each written and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm import exact_dedup, language_id, near_dedup, packing, storage, substring_dedup
from barquarry.llm.queries import vocabulary
from barquarry.llm.storage import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word labeller rejects go: null text, no letter (`und`)."""
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    storage.release(spark)
    found = language_id.predict(docs, model, with_text=True).where("lang_pred != 'und'")
    return found.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id."""
    gone = near_dedup.near_dedup(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut out; documents without any words left go."""
    out = substring_dedup.substring_dedup(docs).where("n_words > n_removed")
    size = F.char_length("text").cast("long")
    return out.select(*["text" if c == "text" else (size if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: The first and the last stage learn and tokenise, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = scratch.write(stage(spark, docs, sf_dir))
        storage.release(spark)
        if at > 1:
            scratch.drop(at - 1)
    return docs
