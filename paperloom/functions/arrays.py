"""Array expressions that take a sort rather than a look at every pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import let


def _starts(ordered: Column) -> Column:
    """Where each run of equal keys begins in an array of struct<key, at> in order."""
    return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["key"] != F.get(ordered, i - 1)["key"]))


def _in_order(keys: Column) -> Column:
    return F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))


def nth(keys: Column) -> Column:
    """Of each key the how-manieth of its equals it is, from 1. Keys aren't null.

    Keys are sorted with their places, so that equal ones stand together; the
    runs' lengths give the numbers, and a sort by place puts them back.
    """

    def numbered(ordered: Column) -> Column:
        ends = lambda starts: F.transform(starts, lambda s, j: F.coalesce(F.get(starts, j + 1), F.size(ordered)) - s)
        numbers = F.flatten(F.transform(let(_starts(ordered), ends), lambda n: F.sequence(F.lit(1), n)))
        back = F.array_sort(F.zip_with(ordered, numbers, lambda k, n: F.struct(k["at"].alias("at"), n.alias("n"))))
        return F.transform(back, lambda x: x["n"])

    return F.when(F.size(keys) > 0, let(_in_order(keys), numbered)).otherwise(F.array().cast("array<int>"))


def firsts(keys: Column) -> Column:
    """Of each distinct key where it first and last is: array<struct<first, last>> by first place."""

    def ends(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)["at"]
        both = lambda starts: F.transform(starts, lambda s, j: F.struct(at(s).alias("first"), at(F.coalesce(F.get(starts, j + 1), F.size(ordered)) - 1).alias("last")))
        return F.array_sort(let(_starts(ordered), both))

    return F.when(F.size(keys) > 0, let(_in_order(keys), ends)).otherwise(F.array().cast("array<struct<first int, last int>>"))
