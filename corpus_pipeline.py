"""The corpus pipeline: from documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and reads them back as the
next one's docs. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, mixing, ngram_join, pii, quality
from tallyfold.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null or empty text is scored as one without words; rows with a null id are
    scored too, repeated rows alike; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five words a shingle, similarity 0.8 or more.

    The smallest id stays, of an id's texts the first; rows with a null id and
    texts without words link with nothing and stay; equal rows of one id become
    one; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each span of personal data; n_chars follows the new text.

    A null text stays null, with n_chars 0; repeated rows and null ids stay as
    they are; an empty table stays empty.
    """
    return pii.redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights.

    A null source is a source of its own; texts without words weigh nothing and
    may be left out; reruns draw alike; an empty table stays empty.
    """
    return mixing.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts; a null or empty text has none, and repeated rows are encoded each."""
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_copy), ("pii", redact), ("mix", mix), ("encode", encode)]

#: A learnt classifier, seeded draws and a tokenizer are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
