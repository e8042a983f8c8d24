"""From documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever their names and number. Empty
tables pass through; null texts go at the first stage, as no language is found in them. Texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import scratch
from lithos.llm.jaccard import one_of_each
from lithos.llm.language import keep_known
from lithos.llm.mixing import mix, training_order, word_count
from lithos.llm.packing import pack_documents
from lithos.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; lang becomes the predicted one.

    Null texts, texts without a letter and those of which no language holds half of the posterior go. Equal
    texts and repeated rows fare alike; ties go to the first language by code point; where no row has a lang to learn from, only
    texts without a letter go and lang stays.
    """
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that five-word shingles link at 0.8, the one with the least doc_id (null last).

    Repeated rows and rows that share an id, or have none, are documents like others: one row of a group
    stays. Null texts and texts without words link with nothing and stay.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that also stand earlier; n_chars follows.

    A text that loses nothing stays as it is; one that loses words has the others joined by one space,
    and may be empty; null texts stay null, with n_chars null. Rows that repeat id and text lose the same words; different
    texts of one id, or of none, are documents of their own.
    """
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; one that the mix takes again stands again, one that it does not take goes.

    Null and empty texts have no words and go. Repeated rows and equal ids have places one behind the other; a null
    source is a source.
    """
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    return training_order(mix(own)).select(*[F.col(f"own.`{c}`").alias(c) for c in names])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 4096.

    A null or empty text is its end token alone; repeated rows are packed each for itself; long texts are cut.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID, the mix's training order and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
