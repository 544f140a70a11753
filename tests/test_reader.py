"""The reader of whole documents against the expressions, on odd texts."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.keywords import marks
from paperloom.operators import chunks, classify, entities, headers, items, reader, tables
from paperloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PARTS = [
    "Invoice Number: INV-7", "INVOICE", "Purchase Order", "Vendor: acme", "Receipt No: 4", "Total: 2.50", "total : 1,234.50", "Order ID: 55", "order no - A-1", "Customer Name: Zoë Ünal", "Customer ID: C9", "customer id:", "Customer Details: Customer ID: X7 Customer Name: Bo",
    "Order Details: Order Date: 2024-01-02", "Order Date: 1/2/2024", "Date: 5 JAN 2020", "é2020-01-01", "2020-01-01é", "²2020-01-01", "5 Märch 2020", "Product: Nut", "product : no label", "éProduct: x", "x Product:Bolt Quantity: 3 Unit  Price: 2.5 Total: 7.5", "Quantity: 12345678.9", "Quantity: .", "Quantity: 0.0001", "Quantity: 1.2.3", "UNIT\tPRICE: 5",
    "goes on", "  ", "", "Amount Due: $1,000.00", "Grand  Total: € 5", "AMOUNT DUE 7", "Key: a", "Key: b", "Key 2: c", "Key: d", "Key 2: e", "Country: Fr", "City: Rome. ", "Ship To: Q", "Due Date: 3", "From: a@b.c", "Subject: hi", "Dear all", "1. first", "- point", "• dot", "agreement between each party", "Whereas " + "long words " * 30, "Total:", "Balance Due: 9.99", "KKey: İx", "A / b - c: d: e", "Bill To – Someone", "Total: 1" + "0" * 400, "end. More", "Contact Name:  \t", "Subtotal", "12.5", "Unit", "Price: 3",
]
ODD = [None, "", "\n", " \n\t\n", "a\r\nb\rProduct: q\r\nmore\rQuantity: 2\r\n", "Product:", "Product: a\n\nb\n c \nQuantity: 1\nd\nProduct: e", "Quantity: 4\nProduct: late\nTotal: 1", " Product: p\u0085- item 1. x", "word. " * 400, "x" * 2000, "é́Product: a", "Unit\nPrice: 4\nProduct: z\nUnit\n Price: 5"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    texts = ODD + ["".join(p + r.choice(["\n", "\n", "\n", "\r\n", " ", "\n\n"]) for p in r.choices(PARTS, k=r.randrange(1, 25))) for _ in range(250)]
    return spark.createDataFrame([(None if i == 40 else f"D{i}", t) for i, t in enumerate(texts)], "doc_id string, full_text string").repartition(3).cache()


@pytest.fixture(scope="module")
def by_expressions(docs):
    return items.normalised(entities.enriched(entities.extracted(classify.classified(docs)))).cache()


def rows(df, *columns):
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    return sorted((tuple(map(shown, r)) for r in df.select(*columns).collect()), key=repr)


def test_fields(docs, by_expressions):
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"typed_fields.{n}").alias("value")) for n in entities.FIELDS]))
    expected = by_expressions.select("doc_id", of.alias("r")).select("doc_id", "r.*").where("value is not null")
    assert rows(reader.field_rows(docs), "doc_id", "field", "value") == rows(expected, "doc_id", "field", "value")


def test_normalised(docs, by_expressions):
    names = ["doc_id", "order_id", "customer_id", "customer_name", "order_date", "ext_total", "calc_total", "total_amount", "confidence"]
    assert rows(reader.normalised(docs), *names) == rows(by_expressions, *names)


def test_texts(docs, by_expressions):
    assert rows(reader.headers(docs), "doc_id", "text") == rows(by_expressions.select("doc_id", chunks.header_text().alias("text")), "doc_id", "text")
    assert rows(reader.summaries(docs), "doc_id", "text") == rows(by_expressions.select("doc_id", chunks.summary_text().alias("text")), "doc_id", "text")


def test_chunks(docs, by_expressions):
    out = reader.chunks(docs).withColumn("chunk_id", chunks.chunk_id(F.col("doc_id"), F.col("number")))
    names = ["doc_id", "chunk_id", "chunk_type", "page_number", "text"]
    assert rows(out, *names) == rows(chunks.document_chunks(by_expressions), *names)


def test_types_with_and_without_tables(spark, docs):
    for tabled in (False, True):
        known = {r[0]: tuple(r[1:]) for r in docs.where("doc_id is not null").select("doc_id", classify.classification(F.col("full_text"), F.lit(tabled), marks(F.col("full_text"))).alias("c")).select("doc_id", "c.document_type", "c.class_confidence").collect()}
        texts = {r[0]: r[1] for r in docs.where("doc_id is not null").collect()}
        found = dict(zip(texts, reader.keywords(list(texts.values())), strict=True))
        assert {d: reader.classification(t or "", tabled, found[d]) for d, t in texts.items()} == known


def test_numbers_as_java_shows_them(spark):
    r = random.Random(3)
    values = [0.0, 1.0, 0.001, 0.00099, 9999999.0, 9999999.99, 1e7, 12345678.9, 1e22, 123456789012.0, 1.5e-7, float("inf"), *[round(r.uniform(0, 1e6), 2) for _ in range(500)]]
    expected = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("cast(v as string)").collect()]
    assert [reader.shown(v) for v in values] == expected


@pytest.mark.parametrize("name", ["total_validation", "completeness_score", "header_chunk", "typed_fields_enriched", "typed_fields_tables", "doc_summary", "doc_chunks"])
def test_documents_are_read_once(spark, name):
    """A whole document is one call, not lambdas that Spark interprets."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("regexp") == 0


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 'a' as doc_id, cast(unhex('50726F647563743A20FF780A5175616E746974793A2032') as string) as full_text")
    assert "Products: �x x2.0" in reader.headers(docs).first()["text"]


CELLS = ["", " ", None, "Order ID:", "Product", "Qty", "Qty", "City", "Customer Name", "Contact  Name:", "Totl", "grand total", " Grand   Total ", "Subtotal", "9.50", "1,000", "Rome", "a:b", "Date", "Buyer\u0085", "Zoë", "12", "x" * 45, "Country:", "order nr", "\t", "KEY:", "total:"]


def test_fields_with_tables(spark, docs):
    r = random.Random(11)
    row = lambda n: [r.choice(CELLS) for _ in range(r.choice([n, n, n, r.randrange(5)]))]
    one = lambda: [row(n) for n in [r.randrange(1, 5)] for _ in range(r.randrange(7))]
    raw = [None, [], [None], [[]], [[None, ["Order ID:", "7"]]], [[["Order ID:", "7"], ["order id", "8"], ["Order ID", "9"]]], *[[one() for _ in range(r.randrange(1, 4))] for _ in range(240)]]
    given = spark.createDataFrame([(f"D{i}", t) for i, t in enumerate(raw)], "doc_id string, raw_tables array<array<array<string>>>")
    both = docs.where("doc_id is not null").join(given, "doc_id", "left").cache()
    known = entities.extracted(classify.classified(tables.normalise_tables(both), tables="raw_tables"), tables="tables")
    values = headers.column_values(tables.normalise_tables(both))
    full = entities.enriched(known.join(values, "doc_id", "left"), lambda f: F.col(f"column_values.{f}"), "tables")
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"typed_fields.{n}").alias("value")) for n in entities.FIELDS]))
    expected = full.select("doc_id", of.alias("r")).select("doc_id", "r.*").where("value is not null")
    assert rows(reader.field_rows(both), "doc_id", "field", "value") == rows(expected, "doc_id", "field", "value")
    names = ["doc_id", *R.ENTITIES, "key_value_pairs", "table_entities", "typed_fields"]
    typed = classify.classified(both, tables="raw_tables").join(values, "doc_id", "left").select("doc_id", "full_text", "document_type", "raw_tables", "column_values")
    assert rows(reader.with_entities(typed), *names) == rows(full, *names)


def test_no_documents(docs):
    assert reader.chunks(docs.where("false")).count() == reader.field_rows(docs.where("false")).count() == 0
