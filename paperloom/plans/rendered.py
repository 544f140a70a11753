"""Business documents rendered from the order tables: one text an order, in eight variants.

The statement runs on Spark and on DuckDB alike, but for how lines are put
together in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("orders", "customer", "nation", "lineitem", "part")

STATEMENT = """
SELECT 'DOC_' || CAST(o.o_orderkey AS STRING) AS doc_id, CAST(o.o_orderkey % 8 AS INT) AS variant,
  CASE o.o_orderkey % 8
    WHEN 1 THEN 'Purchase Order' || chr(10) || 'PO Number: PO-' || CAST(o.o_orderkey AS STRING) || chr(10) || 'Vendor: acme o''neil group ' || CAST(o.o_orderkey % 10 AS STRING) || '.' || chr(10) || 'Ship To: ' || c.c_name || chr(10)
    WHEN 2 THEN 'RECEIPT OF PAYMENT' || chr(10) || 'Receipt No: R-' || CAST(o.o_orderkey AS STRING) || chr(10) || 'Transaction ID: T' || CAST(o.o_orderkey AS STRING) || chr(10) || 'Cashier: 7' || chr(10) || 'Thank you' || chr(10)
    WHEN 3 THEN 'This agreement binds each party from its effective date until termination, and its obligations pass to any successor.' || chr(10) || 'Whereas the parties have signed every clause hereinafter, a penalty is due for breach under the governing law named below.' || chr(10)
    WHEN 4 THEN 'From: sales' || CAST(o.o_orderkey % 7 AS STRING) || '@example.com' || chr(10) || 'To: ' || lower(replace(c.c_name, '#', '.')) || '@example.org' || chr(10) || 'Subject: Order ' || CAST(o.o_orderkey AS STRING) || chr(10) || 'Dear customer' || chr(10) || 'Warning: a delay is pending. Regards' || chr(10)
    WHEN 7 THEN '- all goods were checked' || chr(10) || '- all goods were sent' || chr(10)
    ELSE 'Invoice Number: INV-' || CAST(o.o_orderkey AS STRING) || chr(10) END
  || CASE WHEN o.o_orderkey % 8 = 7 THEN '' ELSE 'Order ID: ' || CAST(o.o_orderkey AS STRING) || chr(10) END
  || CASE WHEN o.o_orderkey % 8 IN (5, 7) THEN '' ELSE 'Customer Name: ' || c.c_name || chr(10) || 'Customer ID: C' || CAST(c.c_custkey AS STRING) || chr(10) END
  || 'Country: ' || n.n_name || chr(10) || 'Order Date: ' || CAST(CAST(o.o_orderdate AS DATE) AS STRING) || chr(10)
  || l.body || chr(10)
  || CASE o.o_orderkey % 8
    WHEN 5 THEN 'Subtotal: ' || CAST(l.total AS STRING)
    WHEN 6 THEN 'Amount Due: $' || CAST(CAST(l.total + 1 AS DECIMAL(14, 2)) AS STRING)
    WHEN 7 THEN 'End of list'
    ELSE 'Amount Due: $' || CAST(l.total AS STRING) END AS full_text
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN (
  SELECT l_orderkey, {joined} AS body, CAST(SUM(price) AS DECIMAL(14, 2)) AS total FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(12, 2)) AS price,
      'Product: ' || p_name || chr(10) || 'Quantity: ' || CAST(CAST(l_quantity AS DECIMAL(12, 2)) AS STRING) || chr(10)
      || 'Unit Price: ' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) || chr(10) || 'Total: ' || CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS STRING) AS line
    FROM lineitem JOIN part ON p_partkey = l_partkey) x
  GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""
SPARK = STATEMENT.format(joined="array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey, line))), x -> x.line), chr(10))")
DUCKDB = STATEMENT.format(joined="string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, line)")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, variant, full_text."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", SPARK)
    return spark.sql(text, **frames)


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and raw_tables: an order's lines as a table with header and footer; as a key/value table; without a header; or ragged, with a blank row and a footer in its first column."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind, text = F.col("l_orderkey") % 4, lambda c, t: F.col(c).cast(t).cast("string")
    part = F.concat(F.lit(" Part  "), F.col("l_partkey").cast("string"))
    cells = F.array(part, text("l_quantity", "decimal(12,2)"), text("l_extendedprice", "decimal(12,2)"))
    kv = F.array(F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(":")), F.col("l_returnflag"))
    bare = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), text("l_quantity", "decimal(12,2)"))
    ragged = F.when(F.col("l_linenumber") % 2 == 0, F.array(part, text("l_quantity", "decimal(12,2)"))).otherwise(F.array(part, text("l_quantity", "decimal(12,2)"), F.lit(None).cast("string"), F.lit("note")))
    row = F.when(kind == 0, cells).when(kind == 1, kv).when(kind == 2, bare).otherwise(ragged)
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("cells"))))
    body = lines.groupBy("l_orderkey").agg(F.transform(ordered, lambda x: x["cells"]).alias("body"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(14,2)").cast("string").alias("total"))
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    with_footer = F.concat(F.array(strings("Product:", "Qty", "Line Total")), "body", F.array(F.array(F.lit(""), F.lit("Subtotal"), F.col("total"))))
    uneven = F.concat(F.array(strings("1", "2"), strings("Item : ", "Qty", "Qty", "")), "body", F.array(strings("", " "), F.array(F.lit(" Grand   Total "), F.lit(""), F.col("total"))))
    kind = F.col("l_orderkey") % 4
    table = F.when(kind == 0, with_footer).when(kind == 3, uneven).otherwise(F.col("body"))
    return body.select(F.concat(F.lit("DOC_"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.array(table).alias("raw_tables"))
