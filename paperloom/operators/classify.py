"""Rule-based document classification: layout, key/value pairs and keyword scores as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.arrays import nth
from paperloom.functions.keywords import hits, marks
from paperloom.functions.text import blank, find_all, let, lines, safe, strip, title


def layout(text: Column) -> Column:
    """The nine layout signals of a text, as a struct."""
    raw = safe(text)

    def signals(ls: Column) -> Column:
        full = F.filter(F.transform(ls, strip), lambda s: s != "")
        size = F.aggregate(full, F.lit(0).cast("long"), lambda n, s: n + F.char_length(s))
        number = F.size(full)
        some = F.greatest(number, F.lit(1))
        return F.struct(
            F.size(ls).alias("total_lines"),
            number.alias("non_empty_lines"),
            (size / some).alias("avg_line_length"),
            raw.rlike(R.CURRENCY).alias("has_currency"),
            (raw.rlike(R.DATE_ISO) | raw.rlike(R.DATE_DMY)).alias("has_dates"),
            raw.rlike(R.NUMBERED_LINE).alias("has_numbered_list"),
            raw.rlike(R.BULLET_LINE).alias("has_bullet_list"),
            raw.rlike(R.CAPITALS_LINE).alias("has_all_caps_headers"),
            ((F.char_length(raw) - F.char_length(F.replace(raw, F.lit(":"), F.lit("")))) / some).alias("colon_ratio"),
        )

    return let(lines(raw), signals)


def has_tables(tables: Column) -> Column:
    """Whether any cell of an array of tables isn't blank."""
    return F.coalesce(F.exists(F.flatten(F.flatten(tables)), lambda c: c.rlike(r"\S")), F.lit(False))


def detected_dates(text: Column, cap: int = 10) -> Column:
    """ISO dates, then day-first ones; with ``cap`` of them or more the first ones as they stand, else without repeats."""
    return let(F.concat(find_all(safe(text), R.DATE_ISO), find_all(safe(text), R.DATE_DMY)), lambda d: F.when(F.size(d) >= cap, F.slice(d, 1, cap)).otherwise(F.array_distinct(d)))


def detected_amounts(text: Column, cap: int = 10) -> Column:
    """Currency signs with their numbers: the first ``cap``, without repeats."""
    glued = F.zip_with(find_all(safe(text), R.MONEY, 1), find_all(safe(text), R.MONEY, 2), lambda s, n: F.concat(s, n))
    return F.array_distinct(F.slice(glued, 1, cap))


PAIRS = "array<struct<key string, value string>>"


def pairs(text: Column, shortest: int = 1, cap: int | None = R.PAIR_CAP) -> Column:
    """Key/value pairs in order: title-case keys, a repeated key with the next free number after it."""
    raw = F.zip_with(find_all(safe(text), R.KEY_VALUE, 1), find_all(safe(text), R.KEY_VALUE, 2), lambda k, v: F.struct(title(strip(k)).alias("key"), strip(v).alias("value")))
    good = F.filter(raw, lambda p: (F.char_length(p["key"]) >= shortest) & (p["value"] != ""))
    if cap:
        good = F.slice(good, 1, cap)

    # A key's number among its equals follows it, unless a text has a key like "Total 2" of its own: then the pairs with that stem are numbered one after the other.
    key = lambda p: p["key"]
    named = lambda ps: F.zip_with(ps, nth(F.transform(ps, key)), lambda p, n: F.struct(F.concat_ws(" ", p["key"], F.when(n > 1, n.cast("string"))).alias("key"), p["value"].alias("value")))
    clash = lambda ns: F.size(F.array_distinct(F.transform(ns, key))) < F.size(ns)
    return let(good, lambda ps: let(named(ps), lambda ns: F.when(clash(ns), _renumbered(ps, ns)).otherwise(ns)))


def _renumbered(ps: Column, ns: Column) -> Column:
    """``ns``, the pairs with their numbers, but those of a stem that gives some name twice with the next number that is free where they stand."""
    stem = lambda k: F.regexp_replace(k, r"( \d+)+$", "")
    twice = F.transform(F.filter(F.zip_with(ns, nth(F.transform(ns, lambda p: p["key"])), lambda p, n: F.struct(p["key"].alias("key"), n.alias("n"))), lambda x: x["n"] > 1), lambda x: stem(x["key"]))

    def free(done: Column, p: Column) -> Column:
        taken = lambda name: F.exists(done, lambda d: d["key"] == name)
        number = F.element_at(F.filter(F.sequence(F.lit(2), F.size(done) + 2), lambda i: ~taken(F.concat_ws(" ", p["key"], i.cast("string")))), 1)
        name = F.when(taken(p["key"]), F.concat_ws(" ", p["key"], number.cast("string"))).otherwise(p["key"])
        return F.concat(done, F.array(F.struct(p["at"].alias("at"), name.alias("key"), p["value"].alias("value"))))

    def mended(stems: Column) -> Column:
        placed = lambda of: F.transform(of, lambda p, i: F.struct(i.alias("at"), p["key"].alias("key"), p["value"].alias("value")))
        theirs = F.filter(placed(ps), lambda p: F.array_contains(stems, stem(p["key"])))
        others = F.filter(F.transform(F.arrays_zip(placed(ns).alias("n"), ps.alias("p")), lambda x: x), lambda x: ~F.array_contains(stems, stem(x["p"]["key"])))
        again = F.aggregate(theirs, F.array().cast("array<struct<at int, key string, value string>>"), free)
        return F.transform(F.array_sort(F.concat(F.transform(others, lambda x: x["n"]), again)), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))

    return let(F.array_distinct(twice), mended)


def value_of(kv: Column, key: str) -> Column:
    """The value of a key among pairs, null if it is blank or missing."""
    return blank(F.get(F.filter(kv, lambda p: p["key"] == key), F.lit(0))["value"])


def type_scores(found: Column) -> list[tuple[str, Column]]:
    """For each type its share of the points that it can reach, 0 without a required word. ``found``: a text's keywords, from ``marks``."""
    out = []
    for name, (required, optional) in R.DOCUMENT_TYPES.items():
        must = hits(found, required)
        points = (must * 2 + hits(found, optional)) / (2 * len(required) + len(optional))
        out.append((name, F.when(must > 0, points).otherwise(0.0)))
    return out


def classification(text: Column, tabled: Column, found: Column | None = None) -> Column:
    """struct<document_type, class_confidence, layout>, as one expression: a filter on a part of it evaluates it once more and no oftener. ``found``: the text's keywords, if they are known."""
    found = marks(text) if found is None else found

    def decide(x: Column) -> Column:
        best, L = x["best"], lambda name: x["layout"][name]
        named = F.when(best["score"] > 0, best["name"]).otherwise("UNKNOWN")

        def boosted(t: Column) -> Column:
            trade = t.isin(*R.TRADE_TYPES)
            boosts = (
                F.when(trade & L("has_currency"), R.CURRENCY_BOOST).otherwise(0.0)
                + F.when(trade & x["tabled"], R.TABLE_BOOST).otherwise(0.0)
                + F.when((t == "CONTRACT") & (L("avg_line_length") > R.PROSE_LINE), R.PROSE_BOOST).otherwise(0.0)
                + F.when((t == "EMAIL") & (L("colon_ratio") > R.COLON_RATIO), R.COLON_BOOST).otherwise(0.0)
            )
            return let(F.struct(t.alias("t"), F.least(best["score"] + boosts, F.lit(1.0)).alias("score")), final)

        def final(y: Column) -> Column:
            by_layout = (
                F.when(y["score"] >= R.KNOWN_CONFIDENCE, None)
                .when(L("has_currency") & x["tabled"], "FINANCIAL_DOCUMENT")
                .when((L("colon_ratio") > R.COLON_RATIO) & L("has_dates"), "STRUCTURED_FORM")
                .when(L("avg_line_length") > R.NARRATIVE_LINE, "NARRATIVE_DOCUMENT")
                .when(L("has_numbered_list") | L("has_bullet_list"), "LIST_DOCUMENT")
            )
            typed = F.coalesce(by_layout, F.when(y["score"] < R.KNOWN_CONFIDENCE, F.lit("UNKNOWN")).otherwise(y["t"]))
            sure = F.when(by_layout.isNotNull(), F.least(y["score"], F.lit(R.HEURISTIC_CAP))).otherwise(y["score"])
            return F.struct(typed.alias("document_type"), sure.alias("class_confidence"), x["layout"].alias("layout"))

        return let(named, boosted)

    # The best score wins; of equal ones the earlier type does. Without any, the type is unknown.
    ranked = F.array_max(F.array(*[F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, score) in enumerate(type_scores(found))]))
    return let(F.struct(ranked.alias("best"), layout(text).alias("layout"), tabled.alias("tabled")), decide)


def classified(df: DataFrame, text: str = "full_text", tables: str | None = None) -> DataFrame:
    """Adds document_type, class_confidence, has_tables, layout (a struct) and keywords (those found, as bits)."""
    tabled = has_tables(F.col(tables)) if tables else F.lit(False)
    out = df.withColumn("has_tables", tabled).withColumn("keywords", marks(F.col(text)))
    return out.withColumn("__class", classification(F.col(text), F.col("has_tables"), F.col("keywords"))).select("*", "__class.*").drop("__class")


def known(df: DataFrame) -> DataFrame:
    """Documents whose type is certain enough."""
    return df.where((F.col("document_type") != "UNKNOWN") & (F.col("class_confidence") >= R.KNOWN_CONFIDENCE))


def profile(df: DataFrame, text: str = "full_text", tables: str | None = None) -> DataFrame:
    """``classified`` with detected_dates, detected_amounts and key_value_pairs, and all of it as JSON in profile_json."""
    out = classified(df, text, tables).withColumns({"detected_dates": detected_dates(F.col(text)), "detected_amounts": detected_amounts(F.col(text)), "key_value_pairs": pairs(F.col(text))})
    return out.withColumn("profile_json", F.to_json(F.struct(F.col("document_type").alias("doc_type"), F.col("class_confidence").alias("confidence"), "has_tables", F.col("layout").alias("layout_hints"), F.map_from_entries("key_value_pairs").alias("key_value_pairs"), "detected_dates", "detected_amounts")))

