"""Tags: domains, document type, vendor, risk and amount.

Words are told from the keywords found in a text (``marks``); where a caller has
them already they are given as ``found``, and the text is not looked through again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.keywords import hits, marks
from paperloom.functions.text import amount, let, safe_lower, strip, title


def domain_scores(found: Column) -> Column:
    """An array of struct<score, order, name>, one a domain."""
    return F.array(*[F.struct(hits(found, words).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(R.DOMAINS.items())])


def domains(text: Column, found: Column | None = None) -> Column:
    """Domains with a strong score, best first; without any, the best if it has a score."""
    def pick(scores: Column) -> Column:
        ranked = F.reverse(F.array_sort(scores))
        strong = F.filter(ranked, lambda s: s["score"] >= R.STRONG_DOMAIN)
        one = F.filter(F.slice(ranked, 1, 1), lambda s: s["score"] > 0)
        return F.transform(F.when(F.size(strong) > 0, strong).otherwise(one), lambda s: s["name"])

    return let(domain_scores(marks(text) if found is None else found), pick)


def risk(text: Column, amount_text: Column, found: Column | None = None) -> Column:
    found = marks(text) if found is None else found
    high, medium = hits(found, R.HIGH_RISK), hits(found, R.MEDIUM_RISK)
    level = F.when((high >= 2) | (F.coalesce(amount(amount_text), F.lit(0.0)) >= R.HIGH_AMOUNT), "High").when((high >= 1) | (medium >= 2), "Medium").otherwise("Low")
    return F.concat(F.lit("Risk:"), level)


def amount_bucket(amount_text: Column) -> Column:
    value, out = amount(amount_text), None
    for bound, name in R.AMOUNT_BUCKETS:
        condition = value.isNotNull() if bound is None else value < bound
        out = F.when(condition, f"Amount:{name}") if out is None else out.when(condition, f"Amount:{name}")
    return out


def vendor(text: Column) -> Column:
    """What follows a vendor label, else a sender label: its first 50 characters in title case, without final punctuation."""
    def named(low: Column, pattern: str) -> Column:
        name = F.regexp_replace(title(F.substring(strip(F.regexp_extract(low, pattern, 1)), 1, 50)), r"[.,;:]+$", "")
        return let(name, lambda n: F.when(F.char_length(n) > 1, n))

    return let(safe_lower(text), lambda low: F.coalesce(*[named(low, p) for p in R.VENDOR_PATTERNS]))


def tags(text: Column, document_type: Column, amount_text: Column, found: Column | None = None) -> Column:
    found = marks(text) if found is None else found
    typed = F.when((document_type != "") & (document_type != "generic_document"), F.concat(F.lit("DocType:"), document_type))
    of_amount = lambda a: F.array(risk(text, a, found), amount_bucket(a))
    rest = F.concat(F.array(typed, F.concat(F.lit("Vendor:"), vendor(text))), let(amount_text, of_amount), F.array(F.lit(R.DEFAULT_STATUS)))
    return F.array_compact(F.concat(domains(text, found), rest))
