"""Retrieval: how many, which, in what order, with what about them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import bounded, chat, vectors
from paperloom.operators.vectors import Retriever, diverse, matches


def unit(n, dim=32, seed=42):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def retriever(spark, types, tags=("Finance", "Q3"), **more):
    v = unit(len(types)) if types else np.zeros((0, 32))
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<double>")
    meta = spark.createDataFrame([(i, t, list(tags), f"text {i}") for i, t in enumerate(types)], "doc_id long, document_type string, tags array<string>, cleaned_text string")
    return Retriever(vs, meta, **more)


def queries(spark):
    return spark.createDataFrame([(0, unit(1, seed=7)[0].tolist())], "query_id long, embedding array<double>")


@pytest.mark.parametrize(("n", "k", "expected"), [(10, 3, 3), (2, 5, 2), (0, 5, 0)])
def test_as_many_as_there_are(spark, n, k, expected):
    assert retriever(spark, ["invoice"] * n, k=k).retrieve(queries(spark)).count() == expected


def test_settings(spark):
    r = retriever(spark, ["invoice"])
    assert (r.k, r.doc_filter) == (5, None)
    with pytest.raises(ValueError):
        vectors.checked_top_k(51)


def test_filter_excludes(spark):
    rows = retriever(spark, ["invoice"] * 4 + ["contract"] * 4, doc_filter="invoice").retrieve(queries(spark)).collect()
    assert len(rows) == 4 and {r["document_type"] for r in rows} == {"invoice"}
    assert all(r["page_content"].startswith("text") and r["tags"] == ["Finance", "Q3"] and r["source"] for r in rows)


def test_limit_comes_before_filter(spark):
    q = unit(1, seed=7)[0]
    vs = spark.createDataFrame([(i, (q * (1 - i / 10)).tolist()) for i in range(5)], "doc_id long, embedding array<double>")
    meta = spark.createDataFrame([(i, "a" if i < 4 else "b", [], "") for i in range(5)], "doc_id long, document_type string, tags array<string>, cleaned_text string")
    assert Retriever(vs, meta, k=1, doc_filter="b").retrieve(queries(spark)).count() == 0


@pytest.mark.parametrize(("n", "k", "expected"), [(20, 5, 5), (3, 8, 3)])
def test_diverse_picks_are_distinct(spark, n, k, expected):
    rows = [(0, i, i + 1, float(x @ unit(1, seed=3)[0]), x.tolist()) for i, x in enumerate(unit(n))]
    got = diverse(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double, embedding array<double>"), k).collect()
    assert len({r["doc_id"] for r in got}) == expected


def test_ties_go_to_the_earlier_candidate(spark):
    rows = [(0, 1, 1, 1.0, [1.0, 0.0]), (0, 2, 2, 0.6, [0.6, 0.8]), (0, 3, 3, 0.0, [0.0, 1.0])]
    got = diverse(spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double, embedding array<double>"), 2).orderBy("pick").collect()
    assert [r["doc_id"] for r in got] == [1, 2]


@pytest.mark.parametrize(("kind", "tags", "needle", "expected"), [("invoice", [], "INVOICE", True), ("x", ["Q3"], "q3", True), ("x", [], "q3", False), ("x", [], None, True), ("x", [], "", True), (None, None, "a", False)])
def test_filter_rule(spark, kind, tags, needle, expected):
    df = spark.createDataFrame([(kind, tags)], "t string, g array<string>")
    assert df.select(matches(F.col("t"), F.col("g"), needle).alias("y")).first()["y"] is expected


def test_document_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([("a", "some words " * 100), ("b", "other")], "doc_id string, text string")
    rows = vectors.document_vectors(docs, vectors.hashed_embedder(16)).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-9 for r in rows) and {r["chunk_count"] for r in rows} == {3, 1}


def test_answers(spark):
    frames = list(chat.answer({"system": "", "user": "Documents:\n[1] (x)\nOne two. Three\n\nQuestion: q"}))
    assert frames[-1] == {"type": "done", "content": "One two"}

    def gone(system, user):
        raise ConnectionError("no server")
        yield

    assert [f["type"] for f in chat.answer({"system": "", "user": ""}, gone)] == ["error"]


def test_memory_keeps_the_last_exchanges(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)] + [(1, 8, "system", "s")], "conv_id long, turn long, role string, text string")
    row = chat.memory(turns, 1).first()
    assert row["n_messages"] == 2 and row["memory"] == "User: t6\nAssistant: t7"
    assert chat.memory(turns.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "k", "without_self"), [(1 << 15, 5, False), (40, 7, True), (7, 1, False), (1000, 600, False)])
def test_block_join_is_the_full_scan(spark, block, k, without_self):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (150, 4)).astype(float)  # many equal scores
    rows = [(i * 3, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (1, None), (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = vectors.search(df, df, k, without_self=without_self, block=block)
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Broadcast", "Cartesian", "Collect"))
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for i, q in enumerate(v):
        order = sorted((-float(q @ x), j * 3) for j, x in enumerate(v) if not (without_self and i == j))[:k]
        assert [(n, d, pytest.approx(-s)) for n, (s, d) in enumerate(order, 1)] == sorted(found[i * 3])
    assert vectors.search(df.where("false"), df, k, block=block).count() == 0 and vectors.search(df, df.where("false"), k, block=block).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_of(seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(0, 4, (9, 30)).astype(float)
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    docs = rng.permutation(30)
    row, column = vectors.best_of(scores, docs, 6)
    for i in range(9):
        expected = sorted((-s, d) for s, d in zip(scores[i], docs) if np.isfinite(s))[:6]
        assert [(-scores[i, c], docs[c]) for c in column[row == i]] == expected


@pytest.mark.parametrize(("groups", "k", "without_self", "block"), [(1, 3, False, 1 << 15), (12, 5, True, 20), (40, 1, False, 1 << 15), (7, 300, False, 50)])
def test_bounded_search_is_the_full_scan(spark, groups, k, without_self, block):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 6)) * 4
    v = centres[rng.integers(0, 8, 240)] + rng.normal(size=(240, 6)) * 0.1
    v[200:] = v[:40]  # equal vectors, and so equal scores
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (999, None), (None, [1.0] * 6)], "vec_id long, embedding array<double>")
    full = {(r["query_id"], r["rank"]): (r["doc_id"], pytest.approx(r["score"])) for r in vectors.search(df, df, k, without_self=without_self).collect()}
    rows = bounded.search(df, bounded.index(df, groups, block=block), k, without_self=without_self).collect()
    assert {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows} == full
    if groups == 12:
        assert np.mean([r["looked_at"] for r in rows]) < 0.5
    assert all(0 < r["looked_at"] <= 1 for r in rows)


def test_bounded_search_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert bounded.search(df, bounded.index(df.where("false"))).count() == 0 and bounded.search(df.where("false"), bounded.index(df)).count() == 0
