"""Session memory as state: order, repeats, clearing and expiry."""

import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chat
from paperloom.sources.buckets import Bucketed
from paperloom.streaming import sessions

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def feed(spark, tmp_path):
    """Feeds batches of turns, one a call, and gives the memories after each."""
    session = sessions.stateful(spark)
    (tmp_path / "in").mkdir()
    table = Bucketed(session, str(tmp_path / "table"), "conv_id", buckets=4)

    def run(rows, until=None, **more):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(TURNS).parquet(str(tmp_path / "in"))
        running = sessions.follow(stream, table, str(tmp_path / "cp"), **more)
        if "ttl" not in more:
            assert running.awaitTermination(60)
        for _ in range(120):
            if until is None or (table.read() is not None and until in {r["memory"] for r in table.read().collect()}):
                break
            time.sleep(0.5)
        running.stop()
        return {r["conv_id"]: r["memory"] for r in table.read().collect()}

    return run


def test_turns_take_their_place(feed):
    assert feed([(1, 5, "user", "e"), (1, 1, "user", "a"), (2, 1, "system", "no"), (None, 1, "user", "x")], exchanges=2) == {1: "User: a\nUser: e", 2: ""}
    late = feed([(1, 3, "assistant", "c"), (1, 2, "user", None), (1, None, "user", "y"), (1, 4, "user", "d")], exchanges=2)
    assert late[1] == "User: a\nAssistant: c\nUser: d\nUser: e"
    again = feed([(1, 4, "user", "d"), (1, 5, "user", "e")], exchanges=2)
    assert again[1] == late[1]
    assert feed([(1, 2, "user", "too early to count"), (1, 6, "user", "f")], exchanges=2)[1] == "Assistant: c\nUser: d\nUser: e\nUser: f"


def test_clear_forgets_late_turns_too(feed):
    feed([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "z")])
    assert feed([(1, 3, "clear", None)])[1] == ""
    assert feed([(1, 2, "assistant", "late"), (1, 4, "user", "new")]) == {1: "User: new", 2: "User: z"}


def test_quiet_sessions_expire(feed):
    feed([(1, 1, "user", "old")], "User: old", ttl=1500)
    time.sleep(2)
    assert feed([(1, 2, "user", "new")], "User: new", ttl=1500)[1] == "User: new"


def test_equal_to_the_batch_form(spark, feed):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").orderBy(F.xxhash64("text", "turn")).collect()]
    feed(rows[: len(rows) // 2])
    got = feed(rows[len(rows) // 2 :])
    assert {c: m for c, m in got.items() if m} == {r["conv_id"]: r["memory"] for r in chat.memory(turns, 10).collect()}
