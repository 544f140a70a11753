"""Every document query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__
from paperloom.plans.oracles import ORACLES
from paperloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rendered_invoice(spark):
    row = QUERIES["doc_classify"](spark, SF).where("doc_id = 'DOC_8'").first()
    assert row["document_type"] == "INVOICE" and abs(row["class_confidence"] - (7 / 12 + 0.15)) < 1e-6
