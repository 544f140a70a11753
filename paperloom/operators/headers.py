"""Columns of tables by names that are only alike, through a dictionary.

Tables are many, their layouts (lists of column names) few, and the names in them
fewer still. So what is costly, the likeness of a name and a label, is worked out
once for each distinct name and each of the labels that are asked for; layouts
choose their columns by a join with that dictionary, and tables take them by a
join with the layouts. All of it is expressions and joins. Dictionary and layouts
are small as long as names repeat, and then Spark, which measures them, broadcasts
them; where they don't, the joins are shuffles, whose hot keys it splits.

Likeness is the share of characters in matching blocks: the longest common part
(of equal ones the first in the label, there the first in the name), then the same
to its left and to its right. One name inside the other counts ``FUZZY_BONUS``
more, 1 at most.

Defined results: blank or null names and labels match nothing; a column name that
a layout has twice is its first; no tables, or no layout that fits, give no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.text import let, strip

Fields = Mapping[str, tuple[str, ...]]
PRODUCTS: Fields = {"name": R.PRODUCT_LABELS, "quantity": R.QUANTITY_LABELS}


def matched(a: Column, b: Column) -> Column:
    """How many characters of a and b are in matching blocks."""
    part = "struct<a string, b string>"
    tail = lambda s, at: F.substring(s, at, F.char_length(s))

    def block(s: Column) -> Column:
        """The longest part of s.a that s.b has: its length n, and where it is in s.a (negative, so that the first is the greatest)."""
        reach = lambda i: F.size(F.filter(F.sequence(F.lit(1), F.char_length(s["a"]) - i + 1), lambda n: F.contains(s["b"], F.substring(s["a"], i, n))))
        return F.array_max(F.transform(F.sequence(F.lit(1), F.char_length(s["a"])), lambda i: F.struct(reach(i).alias("n"), (-i).alias("at"))))

    def split(s: Column, m: Column) -> Column:
        i, n = -m["at"], m["n"]
        j = F.instr(s["b"], F.substring(s["a"], i, n))
        sides = F.array(F.struct(F.substring(s["a"], F.lit(1), i - 1).alias("a"), F.substring(s["b"], F.lit(1), j - 1).alias("b")), F.struct(tail(s["a"], i + n).alias("a"), tail(s["b"], j + n).alias("b")))
        return F.filter(F.when(n > 0, sides).otherwise(F.array().cast(f"array<{part}>")), lambda x: (x["a"] != "") & (x["b"] != ""))

    def step(state: Column, _: Column) -> Column:
        todo = state["todo"]
        one = lambda s: let(block(s), lambda m: F.struct(F.concat(F.slice(todo, F.lit(2), F.size(todo)), split(s, m)).alias("todo"), (state["n"] + m["n"]).alias("n")))
        return F.when(F.size(todo) > 0, let(F.element_at(todo, 1), one)).otherwise(state)

    whole = F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: (x["a"] != "") & (x["b"] != ""))
    begin = F.struct(whole.cast(f"array<{part}>").alias("todo"), F.lit(0).alias("n"))
    # Each block has a character at least, and leaves two parts at most.
    return F.aggregate(F.sequence(F.lit(0), 2 * F.least(F.char_length(a), F.char_length(b))), begin, step, lambda s: s["n"])


def likeness(label: Column, name: Column) -> Column:
    """From 0 to 1; null labels or names give null."""

    def of(x: Column) -> Column:
        share = 2.0 * matched(x["a"], x["b"]) / (F.char_length(x["a"]) + F.char_length(x["b"]))
        inside = F.contains(x["a"], x["b"]) | F.contains(x["b"], x["a"])
        return F.when((x["a"] != "") & (x["b"] != ""), F.when(inside, F.least(share + R.FUZZY_BONUS, F.lit(1.0))).otherwise(share))

    return let(F.struct(F.lower(strip(label)).alias("a"), F.lower(strip(name)).alias("b")), of)


def dictionary(names: DataFrame, labels: Iterable[str]) -> DataFrame:
    """name, label, score: the distinct names (column ``name``) with the labels that they are like enough."""
    asked = F.array(*[F.lit(x) for x in sorted(set(labels))])
    pairs = names.select("name").where(strip(F.col("name")) != "").distinct().select("name", F.explode(asked).alias("label"))
    return pairs.withColumn("score", likeness(F.col("label"), F.col("name"))).where(F.col("score") >= R.FUZZY_THRESHOLD)


def label_columns(layouts: DataFrame, labels: Iterable[str]) -> DataFrame:
    """headers, label, column, score: the column of each layout (``headers``, distinct) that is most like each label, of equal ones the first."""
    cells = layouts.select("headers", F.posexplode("headers").alias("pos", "name"))
    found = cells.join(dictionary(cells, labels), "name")
    best = F.max_by(F.struct(strip(F.col("name")).alias("column"), "score"), F.struct("score", (-F.col("pos")).alias("first")))
    return found.groupBy("headers", "label").agg(best.alias("best")).select("headers", "label", "best.*")


def field_columns(layouts: DataFrame, fields: Fields) -> DataFrame:
    """headers, columns: per layout a struct of the column of each field, by the first of its labels that any column is like."""
    found = label_columns(layouts, [x for labels in fields.values() for x in labels])
    place = lambda labels: F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")), F.lit(0))
    chosen = [F.min_by("column", place(labels)).alias(f) for f, labels in fields.items()]
    return found.groupBy("headers").agg(*chosen).select("headers", F.struct(*fields).alias("columns"))


def data_tables(df: DataFrame, tables: str, key: str) -> DataFrame:
    """key, no, headers, rows: the data tables of ``tables`` (normalised ones), a row each."""
    data = df.select(key, F.posexplode(tables).alias("no", "t")).where("t.table_type = 'data'")
    return data.select(key, "no", F.col("t.headers").alias("headers"), F.col("t.rows").alias("rows"))


def with_columns(data: DataFrame, fields: Fields) -> DataFrame:
    """Data tables that have a column for any of the fields, with their ``columns``."""
    return data.join(field_columns(data.select("headers").distinct(), fields), "headers")


def _cells(row: Column, column: Column) -> Column:
    """What a row has in a column, stripped."""
    return F.filter(F.transform(F.filter(row, lambda c: c["key"] == column), lambda c: strip(F.coalesce(c["value"], F.lit("")))), lambda v: v != "")


def column_values(df: DataFrame, tables: str = "tables", fields: Fields = R.ENRICHED_FIELDS, key: str = "doc_id") -> DataFrame:
    """key, column_values: per document a struct of the fields: the first non-blank cell of the first table whose column for the field has one. Documents without any have no row."""
    found = with_columns(data_tables(df, tables, key), fields)
    first = lambda f: F.get(F.flatten(F.transform("rows", lambda r: _cells(r, F.col(f"columns.{f}")))), F.lit(0))
    valued = found.select(key, "no", *[first(f).alias(f) for f in fields])
    of = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("no"))).alias(f) for f in fields]
    return valued.groupBy(key).agg(*of).select(key, F.struct(*fields).alias("column_values"))


def products(df: DataFrame, tables: str = "tables", key: str = "doc_id") -> DataFrame:
    """key, products: the first ``HEADER_PRODUCTS`` products of a document's data tables, ``name xquantity``, comma-joined.

    A row without a name has no product, one without a quantity is its name
    alone; documents without products have no row.
    """
    found = with_columns(data_tables(df, tables, key), PRODUCTS).where("columns.name is not null")

    def shown(row: Column) -> Column:
        cell = lambda f: F.get(_cells(row, F.col(f"columns.{f}")), F.lit(0))
        return F.concat(cell("name"), F.coalesce(F.concat(F.lit(" x"), cell("quantity")), F.lit("")))

    some = F.slice(F.filter(F.transform("rows", shown), lambda p: p.isNotNull()), 1, R.HEADER_PRODUCTS)
    listed = found.select(key, "no", some.alias("some")).where(F.size("some") > 0)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "some"))), lambda x: x["some"]))
    return listed.groupBy(key).agg(F.array_join(F.slice(ordered, 1, R.HEADER_PRODUCTS), ", ").alias("products"))
