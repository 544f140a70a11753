"""A document run: what fails stays in its own columns, and one evaluation feeds all sinks."""

import json

import pytest

from paperloom.plans import run
from paperloom.sources import store
from paperloom.sources.buckets import Bucketed

PAGE = "array<struct<page_number int, text string, raw_tables array<array<array<string>>>>>"
TABLE = [["Product", "Qty", "City"], ["Nut", "3", "Rome"], ["", "Subtotal", "9.50"]]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("a", [(2, "Amount Due: $9.50\nEnd. ", [TABLE]), (1, "Invoice Number: INV-7\nOrder ID: 5", [])], "x"),
        ("b", [], "y"),
        ("c", None, "z"),
        ("d", [(1, None, None), (2, "Receipt No: 4\nTotal: 2", [])], "w"),
    ]
    return spark.createDataFrame(rows, f"doc_id string, pages {PAGE}, extra string")


@pytest.fixture(scope="module")
def full(pages):
    return rows(run.run(pages))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_steps(full):
    got, a = full, full["a"]
    assert a["document_type"] == "INVOICE" and a["document_mode"] == "TABLE_MODE" and a["typed_fields"]["city"] == "Rome" and a["products"] == "Nut x3"
    assert [c["chunk_type"] for c in a["chunks"]] == ["document_header", "page_text", "page_text", "table", "entity_summary"] and a["chunks"][0]["text"].endswith("Products: Nut x3")
    assert "Table (1 rows): Product, Qty, City" in a["summary"] and json.loads(a["profile_json"])["doc_type"] == "INVOICE" and json.loads(a["normalized_schema"])["order_id"] == "5"
    for r in got.values():
        assert all(r[f"{s.name}_error"] is None for s in run.STEPS) and r["extra"] in "xyzw"
    assert got["b"]["full_text"] == got["c"]["full_text"] == "" and got["c"]["document_type"] == "UNKNOWN" and len(got["c"]["chunks"]) == 2


@pytest.mark.parametrize("name", [s.name for s in run.STEPS])
def test_a_step_that_fails_leaves_the_others(pages, full, name):
    def broken(df):
        raise RuntimeError("planned to fail")

    steps = [run.Step(s.name, s.adds, broken, s.keep) if s.name == name else s for s in run.STEPS]
    got = rows(run.run(pages, steps))
    own = next(s.adds for s in run.STEPS if s.name == name)
    for doc, r in got.items():
        assert r[f"{name}_error"] == "RuntimeError: planned to fail" and all(r[c] is None for c in own)
        assert [r[f"{s.name}_error"] for s in run.STEPS if s.name != name] == [None] * (len(run.STEPS) - 1)
        assert r["full_text"] == full[doc]["full_text"] and (name in ("profile", "entities", "items", "chunks") or r["chunks"] == full[doc]["chunks"])
    if name == "summary":
        assert got["a"]["typed_fields"] == full["a"]["typed_fields"]
    if name == "profile":
        assert got["a"]["dates"] == full["a"]["dates"] and got["a"]["chunks"][1]["text"].startswith("[a / UNKNOWN]")


def test_a_step_without_its_column(pages):
    got = rows(run.guarded(run.documents(pages), run.Step("odd", {"odd": "int"}, lambda df: df)))
    assert got["a"]["odd_error"] == "ValueError: no column odd" and got["a"]["odd"] is None


def test_a_function_that_fails_on_some_rows(pages):
    def size(text):
        if not text:
            raise KeyError("nothing")
        return len(text)

    steps = (run.row_step("model", "length", "long", size, "full_text"), *run.STEPS[:1])
    got = rows(run.run(pages, steps))
    assert got["b"]["model_error"] == "KeyError: 'nothing'" and got["b"]["length"] is None and got["b"]["document_type"] == "UNKNOWN"
    assert got["a"]["model_error"] is None and got["a"]["length"] == len(got["a"]["full_text"])


def test_sinks_of_one_evaluation(spark, pages, tmp_path):
    table = Bucketed(spark, str(tmp_path / "meta"), buckets=4)
    seen = spark.sparkContext.accumulator(0)
    count = run.row_step("seen", "times", "long", lambda text: seen.add(1) or 1, "full_text")
    done = run.write(run.run(pages, (*run.STEPS, count)), str(tmp_path / "out"), table)
    assert seen.value == 4 and done.count() == 4
    assert {r["doc_id"] for r in store.stored_texts(spark, f"{tmp_path}/out/texts").collect()} == set("abcd")
    kept = {r["doc_id"]: r for r in spark.read.json(f"{tmp_path}/out/structured").collect()}
    assert [c["chunk_id"] for c in kept["a"]["chunks"]] == [f"a_chunk_{i:04d}" for i in range(1, 6)] and kept["a"]["document_type"] == "INVOICE"
    assert spark.read.parquet(f"{tmp_path}/out/chunks").where("doc_id = 'a'").count() == 5
    assert {r["doc_id"]: (r["chunk_count"], r["table_count"]) for r in table.read().collect()}["a"] == (5, 1)


def test_empty_run(pages):
    assert run.run(pages.where("false")).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "DOC_1.txt").write_text("one\ntwo")
    (tmp_path / "DOC_2.txt").write_text("")  # of no length
    (tmp_path / "other.json").write_text("{}")
    assert {r["doc_id"]: r["text"] for r in store.text_files(spark, str(tmp_path)).collect()} == {"DOC_1": "one\ntwo"}
