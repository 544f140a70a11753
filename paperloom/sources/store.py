"""Tables of the document store: metadata, vectors and structured results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import rules as R

METADATA = (
    "doc_id STRING, original_filename STRING, stored_filename STRING, file_path STRING, file_type STRING, upload_time STRING, status STRING, ocr_status STRING, ocr_output_path STRING, ocr_char_count INT, ocr_word_count INT, ocr_page_count INT, ocr_duration_s DOUBLE, "
    "extraction_status STRING, document_type STRING, doc_type STRING, doc_type_confidence DOUBLE, chunk_count INT, table_count INT, tags ARRAY<STRING>, extraction_output_path STRING, file_name STRING"
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "paperloom-shared")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/paperloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records of a JSON array; broken files give no rows."""
    return spark.read.schema(METADATA + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True, mode="PERMISSIVE").where("_corrupt is null and doc_id is not null").drop("_corrupt")


def upsert(existing: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The existing rows with those of the same key replaced by new ones, and the other new ones added."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest sequence number of each key."""
    names = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("row")).select(key, "row.*")


def lookup(table: DataFrame, value, key: str = "doc_id") -> DataFrame:
    """The row of a key, if there is one; the condition reaches the scan."""
    return table.where(F.col(key) == value).limit(1)


def insert_absent(index: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    """The index with the new vectors whose key it doesn't have, the first of each."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("embedding").isNull()))
    fresh = new.join(index.select(key), key, "left_anti").withColumn("__r", first).where("__r = 1").drop("__r")
    return index.unionByName(fresh)


def rebuilt(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """An index of all readable vectors, in order of their keys inside each file."""
    return vectors.where(F.col("embedding").isNotNull()).repartitionByRange(key).sortWithinPartitions(key)


def index_size(index: DataFrame) -> int:
    return index.count()


def structured(df: DataFrame) -> DataFrame:
    """doc_id and json: what is persisted of a document, chunk texts cut to STORED_CHUNK characters. ``chunks`` is an array of structs with text."""
    cut = F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["chunk_type"].alias("chunk_type"), c["page_number"].alias("page"), F.substring(c["text"], 1, R.STORED_CHUNK).alias("text")))
    return df.select("doc_id", F.to_json(F.struct(*[c for c in df.columns if c != "chunks"], cut.alias("chunks"))).alias("json"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of a folder of ``{doc_id}.txt``; Spark passes over files of no length, which have no row."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str) -> None:
    """Writes doc_id and text as a Parquet table, one row a document rather than one file each; ``stored_texts`` reads it."""
    df.select("doc_id", "text").write.mode("overwrite").parquet(path)


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text, as ``write_texts`` wrote them."""
    return spark.read.parquet(path).select("doc_id", "text")


def write_structured(df: DataFrame, path: str) -> None:
    """Writes what ``structured`` keeps, one JSON object a line with its doc_id inside."""
    structured(df).select("json").write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Writes doc_id and embedding, without the ones that have no embedding, as a Parquet table in order of their keys."""
    rebuilt(df.select("doc_id", "embedding"), "doc_id").write.mode("overwrite").parquet(path)
