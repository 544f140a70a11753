"""A run over documents: from pages to profile, entities, chunks and summary, each step on its own.

Steps add columns. One that fails, in planning or, where it calls a function a row,
on a row, leaves nulls in its own columns and says why in ``<step>_error``; the steps
after it go on with what there is. The pages' text and normalised tables are written
once, in the folder that executors share, as column names are matched across all
documents, and so are the profile, which the entities' worker is given, and the
entities, which later steps use many times over; each is one pass over the table before it, and ``write`` feeds several sinks from one
evaluation of the whole.

Defined results: null pages are no pages; a document without text has an empty one
and is profiled, chunked and summed up as such; rows with equal doc_ids share what
their tables' columns give; further columns are kept unless a step adds one of the
same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from paperloom.functions import rules as R
from paperloom.operators import chunks, classify, entities, headers, items, reader, tables
from paperloom.sources import ingest, store

FIELDS = "struct<" + ", ".join(f"{f}: string" for f in entities.FIELDS) + ">"
CHUNKS = "array<struct<chunk_type: string, page_number: int, text: string>>"


@dataclass(frozen=True)
class Step:
    """Adds columns, by their types, to documents."""

    name: str
    adds: dict[str, str]
    run: Callable[[DataFrame], DataFrame]
    #: Whether what there is after it is written and read again, as later steps use its columns many times over.
    keep: bool = False


def by_row(function: Callable, kind: str, *inputs: str) -> Column:
    """struct<value, error> of a function of some columns' values, called a row at a time; an exception is that row's error."""

    @F.pandas_udf(StructType([StructField("value", _parse_datatype_string(kind)), StructField("error", StringType())]))
    def run(*columns: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for args in zip(*columns, strict=True):
            try:
                values.append(function(*args))
                errors.append(None)
            except Exception as x:  # noqa: BLE001  whatever the function raises
                values.append(None)
                errors.append(f"{type(x).__name__}: {x}")
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(*inputs)


def row_step(name: str, column: str, kind: str, function: Callable, *inputs: str) -> Step:
    """A step that calls a function (a model, say) for each row."""
    return Step(name, {column: kind}, lambda df: df.withColumn("__row", by_row(function, kind, *inputs)).withColumns({column: F.col("__row.value"), f"{name}_error": F.col("__row.error")}).drop("__row"))


def guarded(df: DataFrame, step: Step) -> DataFrame:
    """``df`` with the columns of the step, or nulls in them, and its error."""
    error = f"{step.name}_error"
    try:
        out = step.run(df.drop(*step.adds, error))
        lacking = [c for c in step.adds if c not in out.columns]
        if lacking:
            raise ValueError(f"no column {', '.join(lacking)}")
        return out if error in out.columns else out.withColumn(error, F.lit(None).cast("string"))
    except Exception as x:  # noqa: BLE001  whatever a step raises
        nulls = {c: F.lit(None).cast(kind) for c, kind in step.adds.items()}
        return df.withColumns(nulls | {error: F.lit(f"{type(x).__name__}: {x}"[:500])})


STEPS = (
    Step("profile", {"document_type": "string", "class_confidence": "double", "has_tables": "boolean", "profile_json": "string"}, lambda df: classify.profile(df, tables="raw_tables").drop("key_value_pairs"), keep=True),
    Step("entities", {**dict.fromkeys(R.ENTITIES, "array<string>"), "key_value_pairs": classify.PAIRS, "table_entities": "array<string>", "typed_fields": FIELDS}, reader.with_entities, keep=True),
    Step("items", {"document_mode": "string", "line_items": f"array<{items.ITEM}>", "total_amount": "double", "confidence": "double", "normalized_schema": "string"}, lambda df: items.normalised(df, tables="raw_tables").withColumn("normalized_schema", F.to_json(items.normalized_schema()))),
    Step("chunks", {"chunks": CHUNKS}, lambda df: df.withColumn("chunks", chunks.chunk_parts("pages", "tables", "products"))),
    Step("summary", {"summary": "string"}, lambda df: df.withColumn("summary", chunks.summary_text("tables"))),
)


def documents(pages: DataFrame) -> DataFrame:
    """Documents (doc_id, pages) with their text, tables, and what the tables' columns give."""
    given = pages.withColumn("pages", F.coalesce("pages", F.array().cast(f"array<{ingest.PAGE}>")))
    known = store.materialise(tables.normalise_tables(ingest.finalised(given)), "documents")
    values, products = headers.column_values(known), headers.products(known)
    return known.join(values, "doc_id", "left").join(products, "doc_id", "left")


def run(pages: DataFrame, steps: Iterable[Step] = STEPS) -> DataFrame:
    """doc_id, pages, full_text, tables and so on, with the columns and the error of each step."""
    out = documents(pages)
    for step in steps:
        out = guarded(out, step)
        if step.keep:
            out = store.materialise(out, step.name)
    return out


def write(done: DataFrame, folder: str, table=None, batch: int = 0) -> DataFrame:
    """Evaluates a run once and writes its sinks from that: ``texts``, ``structured`` (JSON) and ``chunks`` in ``folder``; and, where ``table`` is a bucketed one, the metadata. Returns what was evaluated."""
    known = store.materialise(done.drop("keywords"), "run")
    store.write_texts(known.select("doc_id", F.col("full_text").alias("text")), f"{folder}/texts")
    listed = chunks.listed(known)
    listed.write.mode("overwrite").parquet(f"{folder}/chunks")
    numbered = F.transform("chunks", lambda c, i: F.struct(chunks.chunk_id(F.col("doc_id"), i + 1).alias("chunk_id"), c["chunk_type"].alias("chunk_type"), c["page_number"].alias("page_number"), c["text"].alias("text")))
    store.write_structured(known.select("doc_id", "document_type", "typed_fields", "summary", numbered.alias("chunks")), f"{folder}/structured")
    if table is not None:
        table.upsert(known.select("doc_id", "document_type", F.col("class_confidence").alias("doc_type_confidence"), F.size("chunks").alias("chunk_count"), F.size("tables").alias("table_count"), "ocr_status"), batch)
    return known
