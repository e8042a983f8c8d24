"""Files and processed documents as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.functions.text import document_id, strip
from lithos.operators import chunking

# Suffixes that can be read, and folders that hold derived files.
SUFFIXES = ("txt", "md", "pdf", "docx", "xlsx", "xls", "png", "jpg", "jpeg", "tif", "tiff")
DERIVED = ("processed", "generations")
DOCUMENT = "id string, text string, path string, metadata struct<title:string,source:string>"


def list_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES, skip: Sequence[str] = DERIVED) -> DataFrame:
    """(path, length, suffix) of the readable files below a folder. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(list(suffixes)) & ~F.col("path").rlike("/(" + "|".join(skip) + ")/"))


def read_texts(spark: SparkSession, folder: str, suffixes: Sequence[str] = ("txt", "md")) -> DataFrame:
    """(path, suffix, text, error) of the files below a folder: UTF-8, else cp1251, else latin-1; files of other kinds get an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    plain = files.filter(F.col("suffix").isin(list(suffixes)))
    good = F.is_valid_utf8(F.col("content").cast("string"))

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(_decode)

    other = F.pandas_udf(decode, "string")
    texts = plain.filter(good).select("path", "suffix", F.col("content").cast("string").alias("text")).union(plain.filter(~good).select("path", "suffix", other("content")))
    unread = files.filter(~F.col("suffix").isin(list(suffixes))).select("path", "suffix", F.lit(None).cast("string"), F.concat(F.lit("unsupported: "), "suffix"))
    return texts.withColumn("error", F.lit(None).cast("string")).union(unread)


def _decode(data: bytes) -> str:
    try:
        return data.decode("cp1251")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def assemble(docs: DataFrame) -> DataFrame:
    """Documents with a title: their own, or the file's name."""
    return docs.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.element_at(F.split("path", "/"), -1)))


def processed(spark: SparkSession, folder: str, sources: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Processed documents in file order: JSON files of one document, over any lines, or of one in each line
    (write_processed()); broken ones are left out."""
    texts = spark.read.text(folder, wholetext=True).withColumn("file", F.input_file_name())
    lines = F.filter(F.transform(F.split("value", r"\r\n|\n|\r"), strip), lambda x: x != "")
    each = F.when(F.forall(lines, lambda x: x.startswith("{") & x.endswith("}")), lines).otherwise(F.array("value"))
    parsed = texts.select("file", F.explode(each).alias("value")).select(F.from_json("value", DOCUMENT).alias("d"), "file")
    docs = parsed.filter("d.id IS NOT NULL").select("d.*", "file")
    if sources:
        hit = F.lit(False)
        for s in sources:
            hit = hit | F.lower("metadata.source").contains(s.lower())
        docs = docs.filter(hit)
    return docs if most is None else docs.orderBy("file").limit(most)


def write_processed(docs: DataFrame, folder: str) -> None:
    """One record for each id, the newest version; a thousand in a file at most."""
    docs.groupBy("id").agg(F.max_by(F.struct(*[c for c in docs.columns if c not in ("id", "version")]), "version").alias("d")).select("id", "d.*").write.mode("overwrite").option("maxRecordsPerFile", 1000).json(folder)


def catalog(docs: DataFrame) -> DataFrame:
    """doc_id, title (the id where there is none), source."""
    return docs.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string")).alias("title"), "source")


def source_index(docs: DataFrame) -> DataFrame:
    """Source -> documents; `file#row` sources count for their file as well."""
    own = docs.select("source", "doc_id")
    parent = own.filter(F.col("source").contains("#")).withColumn("source", F.substring_index("source", "#", 1))
    return own.union(parent).groupBy("source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def index_status(files: DataFrame, index: DataFrame) -> DataFrame:
    """(source, indexed, documents) of files (source)."""
    return files.join(index.select("source", "documents"), "source", "left").select("source", F.col("documents").isNotNull().alias("indexed"), F.coalesce("documents", F.lit(0)).alias("documents"))


def missing(files: DataFrame, index: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """Files that are not indexed; of the folders only, if given."""
    if folders:
        hit = F.lit(False)
        for f in folders:
            hit = hit | F.col("source").startswith(f)
        files = files.filter(hit)
    return files.join(index, "source", "left_anti")


def ingested(texts: DataFrame, index: DataFrame, folders: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What of the texts (source, text, error; see read_texts()) is new comes in: its chunks (source, doc_id, chunk_index, text),
    and a row (source, chunks_indexed, skipped, error) for each new file. A file that could not be read is a row with its
    error; one without content is skipped; those already in the index (source) are not touched."""
    new = missing(texts, index.select("source"), folders)
    own = new.filter("error IS NULL").withColumn("doc_id", document_id(F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", ""), F.col("text")))
    chunks = chunking.chunks(own.select("source", "doc_id", "text"))
    counts = chunks.groupBy("source").agg(F.count("*").alias("n"))
    joined = new.select("source", "error").join(counts, "source", "left")
    n = F.coalesce("n", F.lit(0))
    return chunks, joined.select("source", n.alias("chunks_indexed"), (F.col("error").isNull() & (n == 0)).alias("skipped"), "error")


def ingest_summary(results: DataFrame) -> DataFrame:
    """Counts over results (chunks_indexed, skipped, error)."""
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("chunks_indexed") > 0).alias("ingested"), F.count_if(F.coalesce("skipped", F.lit(False))).alias("skipped"), F.count("error").alias("errors"))
