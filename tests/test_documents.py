"""Rules of the document operators on small cases worked out by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunks, classify, entities, headers, items, tables, tags
from paperloom.sources import ingest, store
from paperloom.sources.buckets import Bucketed


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over one row with column x."""
    return lambda x, expression, kind="string": spark.createDataFrame([(x,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


TABLE = "array<array<string>>"


@pytest.mark.parametrize(
    ("text", "kind", "score"),
    [("invoice receipt", "UNKNOWN", 0.2), ("information", "UNKNOWN", 2 / 12), (None, "UNKNOWN", 0.0), ("", "UNKNOWN", 0.0), ("1. one\n2) two", "LIST_DOCUMENT", 0.0), ("x" * 80, "NARRATIVE_DOCUMENT", 0.0)],
)
def test_classification(value, text, kind, score):
    got = value(text, lambda x: classify.classification(x, F.lit(False)))
    assert got["document_type"] == kind and got["class_confidence"] == pytest.approx(min(score, 0.39))


def test_tables_and_currency_make_a_financial_document(value):
    assert value("$5", lambda x: classify.classification(x, F.lit(True)))["document_type"] == "FINANCIAL_DOCUMENT"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Total: 5\nTotal: 7", [("Total", "5"), ("Total 2", "7")]),
        ("Name:\nBob", [("Name", "Bob")]),
        ("Ab-cd", [("Ab", "cd")]),
        ("Total 2: 1\nTotal: 5\nTotal: 7", [("Total 2", "1"), ("Total", "5"), ("Total 3", "7")]),
        (None, []),
    ],
)
def test_pairs(value, text, expected):
    assert [tuple(p) for p in value(text, classify.pairs)] == expected


def test_entity_pairs_need_longer_keys(value):
    assert value("Ab-cd", entities.entity_pairs) == []


@pytest.mark.parametrize("k", ["order-id no/2nd o'neil PO#", "", "ABC def", "a1b"])
def test_title(value, k):
    assert value(k, T.title) == k.title()


@pytest.mark.parametrize(("s", "x"), [("$1,234.50", 1234.5), ("1.2.3", None), ("", None), (None, None), ("5f", 5.0)])
def test_number(value, s, x):
    assert value(s, T.number) == x


@pytest.mark.parametrize("s", ["", "a", "a\n", "a\nb", "a\r\nb\n\n", "\n"])
def test_lines(value, s):
    assert value(s, T.lines) == s.splitlines()


@pytest.mark.parametrize(("s", "bucket"), [("999.99", "Amount:Under1K"), ("1,000", "Amount:1K-5K"), ("50000", "Amount:Over50K"), ("$5", None), (None, None)])
def test_amount_bucket(value, s, bucket):
    assert value(s, tags.amount_bucket) == bucket


@pytest.mark.parametrize(("s", "risk"), [("penalty and breach", "High"), ("penalty", "Medium"), ("warning delay", "Medium"), ("warning", "Low"), (None, "Low")])
def test_risk(value, s, risk):
    assert value(s, lambda x: tags.risk(x, F.lit(None).cast("string"))) == f"Risk:{risk}"


def test_domains_and_vendor(value):
    assert value("bank tax invoice; court law nda legal", tags.domains) == ["Legal", "Finance"]
    assert value("nothing here", tags.domains) == []
    assert value("Vendor Name: acme corp.\nx", tags.vendor) == "Acme Corp"


def test_line_items(value):
    got = value("Product: A\nlarge\nQuantity: 2\nUnit Price: 3\nTotal: 6\nProduct: B\nSubtotal: 9", items.line_items)
    assert [tuple(i) for i in got] == [("A large", 2.0, 3.0, 6.0), ("B", None, None, 9.0)]
    assert value("Quantity: 2 Product: A Product: B", items.line_items)[0]["quantity"] == 2.0
    assert value(None, items.line_items) == []


LINES = ["Product: A", "Product:", "large", "Quantity: 2", "Quantity: x", "Unit Price: 3.5", "Total: $7", "Subtotal: 9", "Product: B Quantity: 4 Total: 1", "", "note"]


def items_line_by_line(lines):
    """The items as they grow, an event after the other."""
    done, now = [], [None] * 4
    for line in filter(None, map(str.strip, lines)):
        parts = re.split(r"(?i)(Product:|Quantity:|Unit\s*Price:|Total:)", line)
        for kind, value in [(re.sub(r"[\s:]", "", k.lower()), v.strip()) for k, v in zip(parts[1::2], parts[2::2])] or [("more", line)]:
            if kind == "product":
                if now[0] is not None:
                    done.append(tuple(now))
                    now = [None] * 4
                now[0] = value
            elif kind == "more":
                if now[0] is not None and now[1] is None:
                    now[0] = f"{now[0]} {value}".strip()
            else:
                digits = re.sub(r"[^0-9.]", "", value)
                at = {"quantity": 1, "unitprice": 2, "total": 3}[kind]
                now[at] = float(digits) if digits else now[at]
    return done + ([tuple(now)] if now[0] is not None else [])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=14), min_size=1, max_size=12))
def test_line_items_of_any_lines(spark, texts):
    got = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "i long, t string").select("i", items.line_items(F.col("t")).alias("x")).collect()
    assert {r["i"]: [tuple(x) for x in r["x"]] for r in got} == {i: items_line_by_line(t) for i, t in enumerate(texts)}


def test_a_hundred_thousand_lines(spark):
    import time

    text = "\n".join(f"Product: P{i}\nQuantity: {i}\nUnit Price: 1\nTotal: {i}" for i in range(25_000))
    start = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(items.line_items(F.col("t")).alias("x")).select(F.size("x").alias("n"), F.element_at("x", -1).alias("last")).first()
    assert got["n"] == 25_000 and tuple(got["last"]) == ("P24999", 24999.0, 1.0, 24999.0)
    assert time.time() - start < 60


@pytest.mark.parametrize(("cells", "expected"), [(["A:", "", "A", ""], ["A", "Column", "A_2", "Column_2"]), ([], []), ([None, "b : "], ["Column", "b"])])
def test_unique_headers(value, cells, expected):
    assert value(cells, tables.unique_headers, "array<string>") == expected


def test_table_rules(value):
    assert not value([["Name", "1"], ["ID:", "2"], ["5", "3"]], tables.is_key_table, TABLE)
    assert value([["1", "2"], ["Qty", "Price"], ["3", "4"]], tables.header_row, TABLE) == 2
    assert tuple(value(["", "Subtotal", "", "9.5"], tables.footer_total, "array<string>")) == ("Subtotal", "9.5")
    assert not value(["Total", "9"], tables.is_footer, "array<string>")
    got = value([["1", "2"], ["Qty", "Price"], ["3", "4"], ["", ""], ["Subtotal", "4"], ["5"]], tables.normalised, TABLE)
    assert got["raw_text"] == "Qty: 3 | Price: 4\nQty: 5 | Price: \nSubtotal: 4".replace("Price: \n", "Price:\n")
    kv = value([["Name:", "Bob"], ["City", None], ["Name", "Al"]], tables.normalised, TABLE)
    assert [tuple(p) for p in kv["kv_pairs"]] == [("Name", "Al"), ("City", "")]


def test_table_entities(spark):
    raw = [[["Name:", "Bob"], ["Order ID", "77"]], [["Qty", "Price"], ["3", "4"], ["Subtotal", "4"]]]
    df = spark.createDataFrame([("d", "Order ID: 5", raw)], f"doc_id string, full_text string, raw_tables array<{TABLE}>")
    df = entities.extracted(classify.classified(tables.normalise_tables(df), tables="raw_tables"), tables="tables")
    full = entities.enriched(df.join(headers.column_values(df), "doc_id", "left"), lambda f: F.col(f"column_values.{f}"), "tables")
    row = full.first()
    assert {p["key"]: p["value"] for p in row["key_value_pairs"]} == {"Order Id": "5", "Name": "Bob"} and row["has_tables"]
    assert row["totals"] == ["4"] and "Qty: 3 | Price: 4" in row["table_entities"] and row["typed_fields"]["order_id"] == "5"
    done = items.normalised(full, tables="raw_tables")
    assert done.first()["document_mode"] == "TABLE_MODE"
    assert [c["chunk_type"] for c in chunks.document_chunks(done, tables="tables").orderBy("chunk_id").collect()] == ["document_header", "page_text", "table", "table", "entity_summary"]


def test_header_takes_products_from_tables_first(spark):
    data = [["Description", "Quantty", "Code"], ["Nut", "3", "5"], ["", "4", "5"], ["Bolt", None, "5"]] + [[f"P{i}", "1", "5"] for i in range(20)]
    raw = [[["Name:", "Bob"], ["City:", "Rome"]], [["Colour", "Size"], ["red", "big"]], data]
    rows = [("a", "Product: X\nQuantity: 2", raw), ("b", "Product: X\nQuantity: 2", []), ("c", None, None)]
    df = spark.createDataFrame(rows, f"doc_id string, full_text string, raw_tables array<{TABLE}>")
    df = tables.normalise_tables(df).withColumn("document_type", F.lit("INVOICE"))
    got = {r["doc_id"]: r["products"] for r in headers.products(df).collect()}
    assert got == {"a": ", ".join(["Nut x3", "Bolt"] + [f"P{i} x1" for i in range(8)])}
    done = items.normalised(entities.extracted(df.join(headers.products(df), "doc_id", "left"), tables="tables"))
    shown = {r["doc_id"]: r["text"] for r in chunks.document_chunks(done, tables="tables", products="products").where("chunk_type = 'document_header'").collect()}
    assert shown["a"].endswith("Products: " + got["a"]) and shown["b"].endswith("Products: X x2.0") and "Products" not in shown["c"]


def test_products_of_all_documents_by_brute_force(spark):
    from paperloom.plans.queries import header_products
    from paperloom.plans.rendered import raw_tables

    sf = "/root/testdata/sf0.001"
    expected = {}
    for doc, (rows,) in raw_tables(spark, sf).collect():
        if int(doc[4:]) % 4 == 0:  # a header, the lines and a subtotal
            expected[doc] = ", ".join(f"{' '.join(p.split())} x{q}" for p, q, _ in rows[1:-1][:10])
    got = {r["doc_id"]: r["products"] for r in header_products(spark, sf).collect()}
    assert {d: x for d, x in got.items() if int(d[4:]) % 4 == 0} == expected


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    store.write_texts(df, f"{tmp_path}/texts")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/texts").collect()), key=repr) == [("a", "x"), ("b", None)]
    chunk = F.struct(F.lit("a_1").alias("chunk_id"), F.lit("page_text").alias("chunk_type"), F.lit(1).alias("page_number"), F.repeat(F.lit("y"), 600).alias("text"))
    store.write_structured(df.select("doc_id", F.array(chunk).alias("chunks")), f"{tmp_path}/structured")
    back = spark.read.json(f"{tmp_path}/structured").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in back] == ["a", "b"] and len(back[0]["chunks"][0]["text"]) == 500
    store.write_vectors(spark.createDataFrame([("a", [1.0]), ("b", None)], "doc_id string, embedding array<float>"), f"{tmp_path}/vectors")
    assert [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/vectors").collect()] == ["a"]


NAMES = st.text(alphabet="abAB _", max_size=9)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(NAMES, NAMES), min_size=1, max_size=40))
def test_likeness_is_the_share_of_matching_blocks(spark, pairs):
    import difflib

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", headers.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for a, b, x in got:
        low, name = a.strip().lower(), b.strip().lower()
        share = difflib.SequenceMatcher(None, low, name).ratio()
        expected = None if not low or not name else min(1.0, share + 0.9) if low in name or name in low else share
        assert x == (expected if expected is None else pytest.approx(expected)), (a, b)


def test_columns_by_names_that_are_alike(spark):
    rows = [("a", ["Product", "Qty", " product "]), ("b", ["Quantty", None, ""]), ("c", []), ("d", ["zzz"])]
    found = headers.label_columns(spark.createDataFrame(rows, "id string, headers array<string>").select("headers"), ["product name", "quantity", "qty"]).collect()
    assert {(tuple(r["headers"]), r["label"], r["column"]) for r in found} == {(("Product", "Qty", " product "), "product name", "Product"), (("Product", "Qty", " product "), "qty", "Qty"), (("Quantty", None, ""), "quantity", "Quantty"), (("Quantty", None, ""), "qty", "Quantty")}


def test_column_values_go_from_table_to_table(spark):
    raw = [[["Order Nr", "City"], ["", "Rome"], ["7", "Oslo"]], [["Order ID", "Country"], ["8", ""], ["9", "Italy"]], [["City:", "Bonn"], ["Country:", "X"]]]
    df = tables.normalise_tables(spark.createDataFrame([("a", raw), ("b", []), ("c", None)], f"doc_id string, raw_tables array<{TABLE}>"))
    got = headers.column_values(df).collect()
    assert [(r["doc_id"], r["column_values"]["order_id"], r["column_values"]["city"], r["column_values"]["country"], r["column_values"]["contact_name"]) for r in got] == [("a", "7", "Rome", "Italy", None)]
    assert headers.column_values(df.where("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=" invoce-tpaylgrm\nİKé", max_size=60), max_size=6), st.integers(0, 700))
def test_keywords_in_one_pass(texts, pad):
    import numpy as np

    from paperloom.functions.keywords import MATCHER

    low = [("x" * pad + t + "total price lab report" * (i % 2)).lower() + "\n" for i, t in enumerate(texts)]
    data = np.frombuffer("".join(low).encode(), np.uint8)
    masks = MATCHER.masks(data, np.cumsum([0, *(len(t.encode()) for t in low)]))
    got = [{w for w, i in MATCHER.bits.items() if int(m[i // 64]) >> i % 64 & 1} for m in masks]
    assert got == [{w for w in MATCHER.words if w in t} for t in low]


def test_matcher_of_nested_words():
    import numpy as np

    from paperloom.functions.keywords import LANE, Matcher

    words = ["a", "ab", "bab", "abcab", "b" * 30, "é"]
    m = Matcher(words)
    for k in range(LANE - 40, LANE + 5):
        text = ("x" * k + "abcab" + "b" * 31 + "é\n").encode()
        mask = m.masks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert [w for w in m.words if int(mask[m.bits[w] // 64]) >> m.bits[w] % 64 & 1] == [w for w in m.words if w in text.decode()]
    assert m.masks(np.zeros(0, np.uint8), np.array([0])).shape == (0, 1)
    with pytest.raises(ValueError, match="several lines"):
        Matcher(["a\nb"])


def numbered_one_by_one(keys):
    done = []
    for k in keys:
        name, i = k, 2
        while name in done:
            name, i = f"{k} {i}", i + 1
        done.append(name)
    return done


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Aa", "Bb", "Aa 2", "Aa 2 2", "Aa 3", "Cc Dd"]), max_size=14), min_size=1, max_size=12))
def test_numbers_of_equal_keys(spark, lists):
    rows = [(i, "\n".join(f"{k}: {j}" for j, k in enumerate(ks))) for i, ks in enumerate(lists)]
    got = {r["i"]: [(p["key"], p["value"]) for p in r["p"]] for r in spark.createDataFrame(rows, "i long, t string").select("i", classify.pairs(F.col("t")).alias("p")).collect()}
    assert got == {i: [(n, str(j)) for j, n in enumerate(numbered_one_by_one(ks))] for i, ks in enumerate(lists)}


def test_a_hundred_thousand_pairs(spark):
    """Sorted once, not compared two by two."""
    import time

    text = "\n".join(f"Key {'abcdefghij'[i % 10]}: {i}" for i in range(100_000))
    start = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(entities.entity_pairs(F.col("t")).alias("p")).select(F.size("p").alias("n"), F.element_at("p", -1).alias("last")).first()
    assert got["n"] == 100_000 and tuple(got["last"]) == ("Key J 10000", "99999")
    assert time.time() - start < 60


@pytest.mark.parametrize(("n", "number"), [(0, 0), (500, 1), (501, 2), (950, 3)])
def test_char_chunks(value, n, number):
    assert len(value("x" * n, chunks.char_chunks)) == number


def boundary_chunks(text: str) -> list[str]:
    t, out, start = text.strip(), [], 0
    if len(t) <= 800:
        return [t] if t else []
    while True:
        w = t[start : start + 400]
        best = max(w.rfind(p) for p in (". ", ".\n", "\n\n"))
        cut = min(len(w), best + 2) if best >= len(w) // 2 else len(w)
        out += [w[:cut].strip()] if w[:cut].strip() else []
        if start + 400 >= len(t):
            return out
        start += max(cut - 80, 1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. ", "line.\n", "\n\n", "é", "x" * 60]), max_size=150).map("".join))
def test_page_chunks(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(chunks.page_chunks(F.col("x")).alias("y")).first()["y"]
    assert got == boundary_chunks(text)


def test_dates_cap_before_repeats(value):
    assert value(" ".join(["2020-01-01"] * 12), classify.detected_dates) == ["2020-01-01"] * 10
    assert value("01/02/2020 2020-01-01 2020-01-01", classify.detected_dates) == ["2020-01-01", "01/02/2020"]


@pytest.mark.parametrize(("name", "ext", "ok"), [("a.PDF", "pdf", True), ("noext", "", False), ("a.b.tiff", "tiff", False), ("x.Jpeg", "jpeg", True), ("/a.v1/report", "", False)])
def test_upload(value, name, ext, ok):
    assert value(name, ingest.extension) == ext and value(name, ingest.accepted) is ok


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, s string")
    new = spark.createDataFrame([(2, "c", 7), (3, "d", 8)], "doc_id long, s string, extra long")
    assert sorted(map(tuple, store.upsert(old, new.drop("extra")).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_corrupt_metadata_gives_no_rows(spark, tmp_path):
    (tmp_path / "m.json").write_text("{broken")
    (tmp_path / "n.json").write_text('[{"doc_id": "DOC_1", "tags": ["a"]}]')
    assert [r["doc_id"] for r in store.read_metadata(spark, str(tmp_path)).collect()] == ["DOC_1"]


def test_files_to_documents_as_a_stream(spark, tmp_path):
    from paperloom.streaming.ingest import ingest as run

    files = tmp_path / "in"
    files.mkdir()
    (files / "a.pdf").write_bytes(b"Invoice Number: INV-1\fpage two")
    (files / "b.txt").write_bytes(b"no")
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(str(files))
    analyse = lambda b: classify.classified(ingest.finalised(ingest.converted(b.where(ingest.accepted(F.col("path"))).select(ingest.document_id(F.col("path")).alias("doc_id"), "path", ingest.extension(F.col("path")).alias("file_type"), "content")))).select("doc_id", "full_text", "page_count")
    table = Bucketed(spark, str(tmp_path / "out"), buckets=4)
    run(stream, analyse, table, str(tmp_path / "cp")).awaitTermination(60)
    (files / "c.pdf").write_bytes(b"Receipt")
    run(stream, analyse, table, str(tmp_path / "cp")).awaitTermination(60)
    assert table.manifest()["batch"] == 1 and table.read().count() == 2
    rows = table.read().where("full_text like 'Invoice%'").collect()
    assert len(rows) == 1 and rows[0]["full_text"] == "Invoice Number: INV-1\n\npage two" and rows[0]["page_count"] == 2


def test_failed_files_keep_their_error(spark):
    def broken(content, kind):
        raise ValueError("bad")

    files = spark.createDataFrame([("D", "p", "pdf", bytearray(b"x"))], "doc_id string, path string, file_type string, content binary")
    assert ingest.converted(files, broken).first()["error"] == "ValueError: bad"


def test_patterns_stay_simple():
    from paperloom.functions import rules

    for pattern, _, _ in rules.ENTITIES.values():
        re.compile(pattern)
        assert "(?=" not in pattern and "(?<" not in pattern
