"""String expressions that other modules share. Whitespace is ASCII throughout."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(fields: Column) -> Column:
    """A struct that is worked out once a row, however often its fields are used: Spark would put the expressions of a bare struct's fields into each use of them."""
    return F.element_at(F.array(fields), 1)


def safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def safe_lower(text: Column) -> Column:
    return F.lower(safe(text))


def strip(text: Column) -> Column:
    """Without white space at either end (``trim`` of itself knows spaces only). Characters are compared from the ends; a pattern would be tried at every place of the text."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def blank(text: Column) -> Column:
    """Null if nothing but white space is there, else stripped."""
    return F.nullif(strip(text), F.lit(""))


def title(text: Column) -> Column:
    """Every run of letters with a capital first; ``initcap`` knows spaces only."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def lines(text: Column) -> Column:
    """The lines of a text; a last line break ends one and begins none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The stripped group of the first match, null if it is blank or there is none."""
    return blank(F.regexp_extract(text, pattern, group))


def hits(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur, as substrings, each once."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def distinct_strings(values: Column, cap: int) -> Column:
    """Stripped, without blanks and repeats, in order, at most ``cap``."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, strip), lambda s: s != "")), 1, cap)


def number(text: Column) -> Column:
    """What digits and dots of a string make, null if that is no number."""
    return F.regexp_replace(safe(text), r"[^0-9.]", "").try_cast("double")


def amount(text: Column) -> Column:
    """A plain number that may have commas; null for anything else."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), strip(plain).try_cast("double"))
