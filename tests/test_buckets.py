"""The bucketed table: what a batch writes, and what is left when it breaks off."""

import os

import pytest

from paperloom.sources.buckets import BUCKET, Bucketed


def files(table):
    return {os.path.relpath(os.path.join(d, n), table.path) for d, _, names in os.walk(f"{table.path}/data") for n in names if n.endswith(".parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def frame(spark, *values):
    return spark.createDataFrame(values, "doc_id long, s string")


@pytest.fixture
def table(spark, tmp_path):
    return Bucketed(spark, str(tmp_path / "t"), buckets=8)


def test_a_batch_writes_the_buckets_it_meets(spark, table):
    first = table.upsert(frame(spark, *[(i, f"a{i}") for i in range(200)]), 0)
    assert first == list(range(8)) and table.batches() == [0]
    before = files(table)
    met = table.upsert(frame(spark, (5, "b5"), (1000, "b1000")), 1)
    assert 1 <= len(met) <= 2
    new = files(table) - before
    assert {f.split("/")[1] for f in new} == {"000000000001"} and len(new) == len(met)
    assert rows(table) == sorted([(i, f"a{i}") for i in range(200) if i != 5] + [(5, "b5"), (1000, "b1000")], key=repr)


def test_a_batch_comes_again(spark, table):
    table.upsert(frame(spark, (1, "a"), (2, "a")), 0)
    table.upsert(frame(spark, (2, "b")), 1)
    state = files(table)
    assert table.upsert(frame(spark, (2, "other")), 1) == [] and table.upsert(frame(spark, (1, "older")), 0) == []
    assert files(table) == state and rows(table) == [(1, "a"), (2, "b")]


def test_broken_off_between_write_and_commit(spark, table, monkeypatch):
    table.upsert(frame(spark, (1, "a"), (2, "a")), 0)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Bucketed, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(frame(spark, (1, "half"), (3, "half")), 1)
    assert rows(table) == [(1, "a"), (2, "a")] and table.batches() == [0]
    table.upsert(frame(spark, (1, "whole"), (3, "whole")), 1)
    assert rows(table) == [(1, "whole"), (2, "a"), (3, "whole")]


def test_a_draft_of_a_manifest_counts_for_nothing(spark, table):
    table.upsert(frame(spark, (1, "a")), 0)
    with open(f"{table.path}/manifest/.000000000001.json.draft", "w") as f:
        f.write("{")
    assert rows(table) == [(1, "a")]
    table.upsert(frame(spark, (1, "b")), 1)
    assert rows(table) == [(1, "b")]


def test_two_writers_of_one_batch(spark, table):
    table.upsert(frame(spark, (1, "a")), 0)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(table.manifest())


def test_old_versions_go_but_the_last(spark, table):
    for n in range(5):
        table.upsert(frame(spark, *[(i, f"v{n}") for i in range(50)]), n)
    assert table.batches() == [3, 4]
    assert {f.split("/")[1] for f in files(table)} == {"000000000003", "000000000004"}
    assert not os.path.exists(f"{table.path}/incoming") or not os.listdir(f"{table.path}/incoming")
    assert {r[1] for r in rows(table)} == {"v4"}


def test_insert_absent(spark, table):
    table.insert_absent(frame(spark, (1, "a"), (2, "a")), 0)
    table.insert_absent(frame(spark, (2, "b"), (3, "b")), 1)
    assert rows(table) == [(1, "a"), (2, "a"), (3, "b")]


def test_edges(spark, table):
    assert table.read() is None
    table.upsert(frame(spark), 0)
    assert table.read().count() == 0
    table.upsert(frame(spark, (None, "x"), (None, "x"), (1, "p"), (1, "q")), 3)
    assert [r[0] for r in rows(table)].count(1) == 1 and [r[0] for r in rows(table)].count(None) == 2
    table.upsert(spark.createDataFrame([(1, "late", 5), (1, "early", 2)], "doc_id long, s string, at long"), 4, order="at")
    got = {(r["doc_id"], r["s"], r["at"]) for r in table.read().collect()}
    assert got == {(None, "x", None), (1, "late", 5)}
    assert BUCKET not in table.read().columns
    table.upsert(frame(spark), 5)
    assert table.manifest()["rewritten"] == [] and table.read().count() == 3
