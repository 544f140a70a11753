"""Entity extraction: typed patterns, fields of known types, and their text form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.arrays import firsts
from paperloom.functions.text import blank, distinct_strings, find_all, first_match, held, let, safe, strip, title
from paperloom.operators.classify import PAIRS, pairs, value_of

FIELDS = sorted({f for fields in R.TYPED_FIELDS.values() for f in fields} | set(R.ENRICHED_FIELDS))



def entity_pairs(text: Column) -> Column:
    """Key/value pairs of entity extraction: keys longer than two characters, as many as there are."""
    return pairs(text, shortest=3, cap=None)


def found(text: Column, kind: str) -> Column:
    """The entities of a kind: stripped, distinct, in order, capped."""
    pattern, group, cap = R.ENTITIES[kind]
    return distinct_strings(find_all(safe(text), pattern, group), cap)


def field(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first of the labels, in their order, that has something after it."""
    return F.coalesce(*[first_match(safe(text), f"(?i)(?:{_escaped(a)}){R.FIELD_VALUE}") for a in labels])


def _escaped(label: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", label)


def typed_fields(text: Column, document_type: Column) -> Column:
    """A struct with every field; those that the type doesn't have are null."""
    kind = F.upper(document_type)
    columns = []
    for name in FIELDS:
        value = F.lit(None).cast("string")
        for t, fields in R.TYPED_FIELDS.items():
            if name in fields:
                value = F.when(kind == t, field(text, fields[name])).otherwise(value)
        columns.append(value.alias(name))
    return held(F.struct(*columns))


def extracted(df: DataFrame, text: str = "full_text", tables: str | None = None) -> DataFrame:
    """Adds a column for each kind of entity, key_value_pairs, table_entities and typed_fields; ``tables`` names normalised tables."""
    out = df.withColumns({kind: found(F.col(text), kind) for kind in R.ENTITIES}).withColumn("key_value_pairs", entity_pairs(F.col(text))).withColumn("typed_fields", typed_fields(F.col(text), F.col("document_type")))
    return with_table_entities(out, tables) if tables else out.withColumn("table_entities", F.array().cast("array<string>"))


def with_table_entities(df: DataFrame, tables: str) -> DataFrame:
    """Adds what tables tell: rows as strings, pairs of key/value tables that the text doesn't have, and footer values among the totals."""
    t = F.col(tables)
    row_text = lambda cells: strip(F.array_join(F.transform(cells, lambda c: F.concat(c["key"], F.lit(": "), strip(c["value"]))), " | "))
    rows = F.flatten(F.transform(t, lambda x: F.transform(F.slice(x["rows"], 1, R.TABLE_ROWS), row_text)))
    more = F.flatten(F.transform(F.filter(t, lambda x: x["table_type"] == "key_value"), lambda x: F.transform(x["kv_pairs"], lambda p: F.struct(title(strip(p["key"])).alias("key"), strip(p["value"]).alias("value")))))
    good = F.filter(more, lambda p: (p["key"] != "") & (p["value"] != ""))
    both = F.concat(F.col("key_value_pairs").cast(PAIRS), good.cast(PAIRS))
    # The text's own pairs have distinct keys and come first, so that they stay, and of the tables' the first of each other key.
    joined = let(both, lambda ps: F.transform(firsts(F.transform(ps, lambda p: p["key"])), lambda x: F.get(ps, x["first"])))
    totals = F.flatten(F.transform(t, lambda x: F.transform(x["totals"], lambda f: f["value"])))
    cap = F.greatest(F.size(t), F.lit(1)) * R.TABLE_ROWS
    return df.withColumns(
        {
            "table_entities": F.slice(F.array_distinct(F.filter(rows, lambda s: s != "")), F.lit(1), cap),
            "key_value_pairs": joined,
            "totals": distinct_strings(F.concat("totals", totals), R.ENTITIES["totals"][2]),
        }
    )


def enriched(df: DataFrame, column_value=None, tables: str | None = None) -> DataFrame:
    """Fills blank fields from key/value pairs, then from table columns (``column_value``: field -> column), then the total from table footers."""
    fields = {}
    for name in FIELDS:
        options = [blank(F.col(f"typed_fields.{name}"))]
        if name in R.ENRICHED_FIELDS:
            options += [value_of(F.col("key_value_pairs"), label.title()) for label in R.ENRICHED_FIELDS[name]]
            if column_value is not None:
                options.append(column_value(name))
        if name == "total_amount" and tables:
            options.append(F.get(F.filter(F.flatten(F.transform(F.col(tables), lambda x: F.transform(x["totals"], lambda f: blank(f["value"])))), lambda v: v.isNotNull()), F.lit(0)))
        fields[name] = F.coalesce(*options)
    return df.withColumn("typed_fields", held(F.struct(*[v.alias(k) for k, v in fields.items()])))


def field_lines(typed: Column, separator: str, indent: str = "") -> list[Column]:
    """``name: value`` of each field that is set, in the order in which types list them."""
    order = list(dict.fromkeys([f for fields in R.TYPED_FIELDS.values() for f in fields] + list(R.ENRICHED_FIELDS)))
    return [F.when(typed[name].isNotNull(), F.concat(F.lit(f"{indent}{name}{separator}"), typed[name])) for name in order]


def entities_text(document_type: Column, typed: Column, totals: Column, dates: Column, kv: Column, rows: Column) -> Column:
    """The entities in sections, a line each; a section without entries is left out."""
    fields = F.array_compact(F.array(*field_lines(typed, ": ", "  ")))
    section = lambda name, body: F.when(F.size(body) > 0, F.concat(F.lit(name), F.lit("\n"), F.array_join(body, "\n")))
    return strip(
        F.concat_ws(
            "\n",
            F.concat(F.lit("[ / "), F.coalesce(document_type, F.lit("UNKNOWN")), F.lit("]")),
            section("Key Fields:", fields),
            F.nullif(F.array_join(F.transform(totals, lambda t: F.concat(F.lit("Total Amount: "), t)), "\n"), F.lit("")),
            F.when(F.size(dates) > 0, F.concat(F.lit("Dates: "), F.array_join(dates, ", "))),
            section("Document Fields:", F.transform(kv, lambda p: F.concat(F.lit("  "), p["key"], F.lit(": "), p["value"]))),
            section("Table Data:", F.transform(F.slice(rows, 1, 20), lambda r: F.concat(F.lit("  "), r))),
        )
    )


def information(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Extraction from a text alone (``text``, or the stored one by doc_id): cleaned_text, extraction_status and the entities of an unknown type."""
    if stored is not None:
        df = df.join(stored.select("doc_id", F.col("text").alias("__stored")), "doc_id", "left").withColumn("text", F.coalesce("text", "__stored")).drop("__stored")
    out = df.withColumn("cleaned_text", strip(safe(F.col("text")))).withColumn("extraction_status", F.when(F.col("cleaned_text") == "", "empty").otherwise("success")).withColumn("document_type", F.lit("UNKNOWN"))
    return extracted(out, "cleaned_text")
