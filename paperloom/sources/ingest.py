"""Files to documents: upload checks, conversion and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.text import strip

#: A converter turns a file's bytes and extension into pages: (page_number, text, tables).
Converter = Callable[[bytes, str], list[tuple[int, str, list]]]
PAGE = "struct<page_number int, text string, raw_tables array<array<array<string>>>>"


def extension(filename: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    name = F.substring_index(filename, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def accepted(filename: Column) -> Column:
    return extension(filename).isin(*R.UPLOAD_TYPES)


def document_id(path: Column) -> Column:
    """A document's id from its path: the same file has the same id."""
    return F.concat(F.lit("DOC_"), F.upper(F.substring(F.sha2(path, 256), 1, 8)))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """The accepted files of a folder: doc_id, path, file_type, upload_time and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(accepted(F.col("path"))).select(document_id(F.col("path")).alias("doc_id"), "path", extension(F.col("path")).alias("file_type"), F.col("modificationTime").alias("upload_time"), "content")


def plain_text(content: bytes, kind: str) -> list[tuple[int, str, list]]:
    """A stand-in for a converter: form feeds part the pages of a text."""
    return [(i, page, []) for i, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1)]


def converted(files: DataFrame, converter: Converter = plain_text) -> DataFrame:
    """doc_id, path, pages and error: a file that fails is kept with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, path, kind, content in zip(frame["doc_id"], frame["path"], frame["file_type"], frame["content"], strict=True):
                try:
                    pages, error = [{"page_number": n, "text": t, "raw_tables": x} for n, t, x in converter(content, kind)], None
                except Exception as x:  # noqa: BLE001  whatever a converter raises
                    pages, error = [], f"{type(x).__name__}: {x}"
                rows.append((doc, path, pages, error))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "pages", "error"])

    return files.select("doc_id", "path", "file_type", "content").mapInPandas(run, f"doc_id string, path string, pages array<{PAGE}>, error string")


def finalised(df: DataFrame) -> DataFrame:
    """Adds full_text (non-blank pages, parted by an empty line), raw_tables of all pages, counts and ocr_status."""
    texts = F.filter(F.transform(F.array_sort("pages", lambda a, b: a["page_number"] - b["page_number"]), lambda p: strip(F.coalesce(p["text"], F.lit("")))), lambda t: t != "")
    out = df.withColumn("full_text", F.array_join(texts, "\n\n")).withColumn("raw_tables", F.flatten(F.transform("pages", lambda p: p["raw_tables"])))
    words = F.regexp_count("full_text", F.lit(r"\S+"))
    return out.withColumns({"char_count": F.char_length("full_text"), "word_count": words, "page_count": F.size("pages"), "ocr_status": F.when(F.col("full_text") != "", "success").otherwise("empty")})


def tables_by_page(tables: DataFrame) -> DataFrame:
    """doc_id, page_number and raw_tables from one table a row (doc_id, page_number, table_no, rows)."""
    ordered = F.array_sort(F.collect_list(F.struct("table_no", "rows")))
    return tables.groupBy("doc_id", "page_number").agg(F.transform(ordered, lambda t: t["rows"]).alias("raw_tables"))
