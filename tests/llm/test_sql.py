"""Queries that SQL can express, against it."""

import pytest

from paperloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
