"""Line items, document mode, total validation and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.text import blank, find_all, first_match, let, lines, number, safe, strip
from paperloom.operators.classify import value_of

ITEM = "struct<product string, quantity double, unit_price double, line_total double>"


def document_mode(text: Column, tables: Column | None = None) -> Column:
    """TABLE_MODE with tables, FORM_MODE with labelled products, else UNKNOWN."""
    form = F.when(safe(text).rlike(R.PRODUCT_LABEL), "FORM_MODE").otherwise("UNKNOWN")
    return form if tables is None else F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, "TABLE_MODE").otherwise(form)


def _events(text: Column) -> Column:
    """Per line what each label is followed by, or the line itself where it has none."""
    def of(line: Column) -> Column:
        labels = F.transform(find_all(line, R.ITEM_LABELS, 1), lambda x: F.regexp_replace(F.lower(x), r"[\s:]", ""))
        values = F.transform(F.slice(F.split(line, R.ITEM_LABELS), 2, 1 << 20), strip)
        return F.when(F.size(labels) > 0, F.zip_with(labels, values, lambda k, v: F.struct(k.alias("kind"), v.alias("value")))).otherwise(F.array(F.struct(F.lit("more").alias("kind"), line.alias("value"))))

    full = F.filter(F.transform(lines(safe(text)), strip), lambda x: x != "")
    return F.flatten(F.transform(full, of))


def line_items(text: Column) -> Column:
    """Items in order: a product label begins one, the other labels fill it, and bare lines go on with its name until it has a quantity.

    What stands before the first product fills its item. The events are parted at
    the products, so that each item is made of its own and a long document takes
    time in proportion to its lines.
    """
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("product", "string"), ("quantity", "double"), ("unit_price", "double"), ("line_total", "double"))])

    def fill(now: Column, e: Column) -> Column:
        taken = lambda label, name: F.when(e["kind"] == label, F.coalesce(number(e["value"]), now[name])).otherwise(now[name]).alias(name)
        goes_on = (e["kind"] == "more") & now["product"].isNotNull() & now["quantity"].isNull()
        product = F.when(e["kind"] == "product", e["value"]).when(goes_on, strip(F.concat_ws(" ", now["product"], e["value"]))).otherwise(now["product"])
        return F.struct(product.alias("product"), taken("quantity", "quantity"), taken("unitprice", "unit_price"), taken("total", "line_total"))

    def parted(events: Column) -> Column:
        products = F.filter(F.transform(events, lambda e, i: F.when(e["kind"] == "product", i)), lambda i: i.isNotNull())

        def each(starts: Column) -> Column:
            start = lambda s, j: F.when(j == 0, 0).otherwise(s)
            own = lambda s, j: F.slice(events, start(s, j) + 1, F.coalesce(F.get(starts, j + 1), F.size(events)) - start(s, j))
            return F.transform(starts, lambda s, j: F.aggregate(own(s, j), empty.cast(ITEM), fill))

        return let(products, each)

    return let(_events(text), parted)


def normalised(df: DataFrame, text: str = "full_text", tables: str | None = None) -> DataFrame:
    """Adds document_mode, line_items, order_id, customer_id, customer_name, order_date, ext_total, calc_total, total_amount and confidence."""
    t, kv, typed = safe(F.col(text)), F.col("key_value_pairs"), lambda n: blank(F.col(f"typed_fields.{n}"))
    pick = lambda n: F.coalesce(typed(n), value_of(kv, n.replace("_", " ").title()))
    nested = lambda n, blob, pattern: F.coalesce(pick(n), first_match(F.coalesce(value_of(kv, blob), F.lit("")), pattern), first_match(t, pattern))
    mode = document_mode(F.col(text), F.col(tables) if tables else None)
    out = df.withColumn("document_mode", mode).withColumn("line_items", F.when(F.col("document_mode") == "FORM_MODE", line_items(F.col(text))).otherwise(F.array().cast(f"array<{ITEM}>")))
    out = out.withColumns(
        {
            "order_id": pick("order_id"),
            "customer_id": nested("customer_id", "Customer Details", r"(?i)Customer\s+ID\s*[:\-]\s*(\S+)"),
            "customer_name": nested("customer_name", "Customer Details", r"(?i)Customer\s+Name\s*[:\-]\s*([^\n]+)"),
            "order_date": nested("date", "Order Details", r"(?i)Order\s+Date\s*[:\-]\s*(\S+)"),
            "ext_total": F.coalesce(number(pick("total_amount")), F.lit(0.0)),
            "calc_total": F.aggregate("line_items", F.lit(0.0), lambda a, i: a + F.coalesce(i["line_total"], F.lit(0.0))),
        }
    )
    some, agree = F.size("line_items") > 0, F.abs(F.col("calc_total") - F.col("ext_total")) <= R.TOTAL_TOLERANCE
    points = lambda condition, x: F.when(condition, x).otherwise(0.0)
    score = points(some, 0.4) + points(some & F.forall("line_items", lambda i: i["line_total"].isNotNull()), 0.2) + points(some & agree, 0.2) + points(F.col("order_id").isNotNull(), 0.1) + points(F.col("customer_name").isNotNull(), 0.1)
    return out.withColumns({"total_amount": F.when(some & ~agree, F.col("calc_total")).otherwise(F.col("ext_total")), "confidence": F.least(score, F.lit(1.0))})


def normalized_schema() -> Column:
    """The six normalised fields of ``normalised`` as a struct."""
    return F.struct("order_id", "customer_name", "customer_id", F.col("order_date").alias("date"), "line_items", "total_amount")
