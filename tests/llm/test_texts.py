"""Operators that look at single documents: extraction, fingerprints, language, language model, quality, decontamination."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from automaton import Automaton
from paperloom.llm import decontaminate, fingerprint, language_id, lm_score, quality
from paperloom.llm.common import NOT_ALNUM, flat, words
from paperloom.llm.html_extract import extract, main_text

SF = "/root/testdata/sf0.001"
BODY = "This is a long paragraph, with commas, of the article; it goes on for a while so that it counts. "


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é \n.%\x1f中", max_size=30)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    for separators, pattern in ((None, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(data, offsets) if separators is None else words(data, offsets, separators)
        got = [[bytes(data[a:b]).decode().lower() if separators is not None else bytes(data[a:b]).decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])] for r in range(len(texts))]
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if separators is not None else t or "" for t in texts]
        assert got == [re.findall(pattern, t) for t in low]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Only   &amp; \n text.</p>", "Only & text."),
        (f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class=ad>Buy!</div><article><h1>Title</h1><p><b>One <i>two</i><br>three.<p>{BODY}</article><footer>(c)</footer></body></html>", f"Title\n\nOne two three.\n\n{BODY.strip()}"),
        (f"<body><div id=sidebar>{BODY}</div><div class=content><p>{BODY}</p><p>Short.</p><p>{BODY * 2}</p></div><div class=comments><p>{BODY}</p></div><script>var a='<p>no</p>';</script></body>", f"{BODY.strip()}\n\nShort.\n\n{(BODY * 2).strip()}"),
        (f"<main><header><h1>T</h1></header><p>{BODY}</p><form>Mail <input></form><ul><li>{BODY}</li><li><a href=y>More</a></li></ul><aside>no</aside></main>", f"T\n\n{BODY.strip()}\n\n{BODY.strip()}\n\nMore"),
        (f"<article><p>A &lt;b&gt; &eacute;&nbsp;x<!-- <p>no</p> --></p><div hidden>no</div><p>{BODY}", f"A <b> é x\n\n{BODY.strip()}"),
        ("<nav>only</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>", "<div class=has-sidebar>", "<div class='no-sidebar'>", "<div id=content-sidebar-wrap>", "<form><article>"])
def test_wrappers_of_the_text_are_kept(wrapper):
    page = f"<body><nav>Home</nav>{wrapper}<div class=text><p>{BODY}</p><p>Short.</p><p>{BODY * 2}</p></div><div class=sidebar><p>{BODY}</p></div>"
    assert main_text(page) == f"{BODY.strip()}\n\nShort.\n\n{(BODY * 2).strip()}"


def plain_page(names=("a", "b", "c", "d")):
    """A page without article, main, nav or telling names: links, a notice, the text, other links and a last line."""
    links = "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(8))
    return f"<body><div class={names[0]}><ul>{links}</ul></div><div class={names[1]}>Prices may change</div><div class={names[2]}><h2>Title</h2><p>{BODY}</p><p>Short.</p><p>{BODY * 2}</p><pre>x = 1</pre><h3>Note</h3><ul><li>one</li><li><a href=y>See the 2019 report</a></li></ul><blockquote>Short end</blockquote></div><div class={names[3]}><ul>{links}</ul>All rights reserved</div></body>"


def test_paths_decide_without_telling_names():
    text = f"Title\n\n{BODY.strip()}\n\nShort.\n\n{(BODY * 2).strip()}\n\nx = 1\n\nNote\n\none\n\nSee the 2019 report\n\nShort end"
    assert main_text(plain_page()) == text == main_text(plain_page(("x1", "has-sidebar", "menu-none", "z")))
    assert main_text(plain_page(), threshold=0.0) != text  # every path passes: the whole page is the article
    assert "Prices may change" in main_text(plain_page(), threshold=0.0)


def test_ratios_of_paths_by_brute_force():
    from paperloom.llm import html_extract as H

    found, elements = H.blocks(plain_page())
    H._weigh(found, elements)
    path = lambda e: (*path(e.parent), e.label) if e else ()
    mine = [(path(b.element), len(b.text) - b.linked, b.marks) for b in found]
    ratio = lambda k, plus: [sum(plus + m[k] for m in mine if m[0] == x[0]) / sum(m[0] == x[0] for m in mine) for x in mine]
    near = lambda v, i: sum(math.exp(-(d * d) / 2) * v[i + d] for d in range(-2, 3) if 0 <= i + d < len(v)) / sum(math.exp(-(d * d) / 2) for d in range(-2, 3) if 0 <= i + d < len(v))
    mean = lambda v: [sum(near(v, j) for j in range(len(v)) if mine[j][0] == x[0]) / sum(m[0] == x[0] for m in mine) for x in mine]
    marks = [(1 + sum(m[2] for m in mine if m[0] == x[0])) / sum(m[0] == x[0] for m in mine) for x in mine]
    score = [a * b for a, b in zip(mean(ratio(1, 0)), mean(marks))]
    passing = {x[0] for x, y in zip(mine, score) if y >= 0.3 * sum(score) / len(score)}
    assert {path(b.element) for b in found if b.element.path in H.content_paths(found)} == passing


@pytest.mark.parametrize("page", ["<div>" * 50_000 + BODY, "<ul><li>a" * 20_000 + BODY, "<p>x</section><blockquote>" * 20_000, f"<p>{BODY * 30_000}"])
def test_deep_and_long_pages_take_linear_time(page):
    import time

    start = time.process_time()
    assert main_text(page)
    assert time.process_time() - start < 20


def test_comments_longer_than_the_text_are_no_wrapper():
    assert main_text(f"<body><div class=text><p>{BODY}</p></div><div class=comments>{f'<div><p>{BODY}</p></div>' * 5}</div>") == BODY.strip()


@pytest.mark.parametrize(
    ("part", "text"),
    [
        (f"<section class='related-work'><h2>Related work</h2><p>{BODY}</p></section>", "Related work\n\n" + BODY.strip()),
        (f"<section class='related'><h2>Related</h2><p>{BODY * 2}</p><p>{BODY}</p></section>", "Related\n\n" + (BODY * 2).strip() + "\n\n" + BODY.strip()),
        ("<p id=recommended-dose>Take two a day.</p>", "Take two a day."),
        ("<p class='share'>Share price fell, by 3.</p>", "Share price fell, by 3."),
        ("<p class='reply'>The minister's reply was short.</p>", "The minister's reply was short."),
        ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> holds.</p>", "So x=2 holds."),
    ],
)
def test_names_of_article_text_remove_none_of_it(part, text):
    assert main_text(f"<body><article><h1>Title</h1><p>{BODY}</p>{part}<p>{BODY}</p></article></body>") == f"Title\n\n{BODY.strip()}\n\n{text}\n\n{BODY.strip()}"


@pytest.mark.parametrize(
    "part",
    [
        "<div class='share-buttons'><a href=x>Share this</a> <a href=y>Post it</a></div>",
        "<p class='advert'>Buy two, pay one.</p>",
        "<div class='relatedPosts'><ul><li><a href=a>One thing</a></li><li><a href=b>Another</a></li></ul></div>",
        f"<section id=comments><div class=comment-body><p>{BODY}</p></div></section>",
        "<div class='cookie-notice'>We use cookies. Accept them.</div>",
        "<p class='newsletter-form'>Write to us, every week.</p>",
    ],
)
def test_furniture_inside_an_article_goes(part):
    assert main_text(f"<body><article><h1>Title</h1><p>{BODY}</p>{part}<p>{BODY}</p></article></body>") == f"Title\n\n{BODY.strip()}\n\n{BODY.strip()}"


def test_extract_keeps_every_page(spark):
    rows = extract(spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>é</p>", "y")], "page_id long, url string, html string, text string")).collect()
    assert sorted((r["n_chars"], r["text"]) for r in rows) == [(0, ""), (0, ""), (1, "é")]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fingerprints(spark, make, words):
    from paperloom.llm import common

    long = words(3000, 1)
    texts = [(5, long), (9, long), (7, None), (3, ""), (11, words(900, 2) + " é"), (None, "no id here"), (2, "One two"), (4, words(300, 4))]
    docs = make(texts)
    fingerprint.read, kept = (lambda *_: docs), fingerprint.read
    try:
        rows = {r["doc_id"]: r for r in fingerprint.op4_document_fingerprints(spark, "").collect()}
    finally:
        fingerprint.read = kept
    del common
    ids = sorted(i for i, _ in texts if i is not None)
    text = {i: t or "" for i, t in texts}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        quarter = len(text[i]) // 4
        edited = text[i][: len(text[i]) - quarter] + text[j][:quarter]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(text[i])
    assert rows[5]["fingerprint"] == rows[9]["fingerprint"] != rows[11]["fingerprint"] and rows[7]["fingerprint"] == "" == rows[3]["fingerprint"]
    a, b = set(zip(*[long.split()[k:] for k in range(5)])), None
    edited = long[: len(long) - len(long) // 4]
    b = set(zip(*[edited.split()[k:] for k in range(5)]))
    assert abs(rows[5]["near_edited"] - len(a & b) / len(a | b)) < 0.15 and rows[11]["near_next"] < 0.05
    assert rows[None]["near_next"] is None


def test_sketches_merge(spark, words):
    one, two = words(400, 5), words(500, 6)
    row = spark.createDataFrame([(one, two, one + " . " + two)], "a string, b string, c string").select(*[fingerprint.sketch(F.col(c)).alias(c) for c in "abc"]).select("*", fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.containment(F.col("a"), F.col("c")).alias("in_c")).first()
    assert set(row["m"]) <= set(row["c"]) and row["in_c"] == 1.0 and len(row["c"]) - len(row["m"]) <= 6


def test_short_texts_are_compared_exactly_and_never_wrongly_with_long_ones(spark, words):
    long = words(3000, 1).split()
    short = [(" ".join(long[i : i + 5 + i % 9]), " ".join(long[i + i % 4 : i + 9]), " ".join(long)) for i in range(200)] + [("", "", "x"), ("one two", "one two", "ONE two"), ("a b", "c d", "")]
    a, b, c = (fingerprint.sketch(F.col(x)) for x in "abc")
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1 if t else 0))}
    rows = spark.createDataFrame(short, "a string, b string, c string").select("a", "b", fingerprint.likeness(a, b).alias("j"), fingerprint.containment(a, b).alias("in_b"), fingerprint.containment(a, c).alias("in_c"), fingerprint.fingerprint(a).alias("f"), fingerprint.merge(a, b).alias("m"), fingerprint.sketch(F.concat_ws(" ", "a", "b")).alias("all")).collect()
    for r in rows:
        x, y = sets(r["a"]), sets(r["b"])
        assert r["j"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1) and r["in_b"] == pytest.approx(len(x & y) / len(x) if x else 1)
        assert bool(r["f"]) == bool(x) and len(r["m"]) == (len(x | y) + 1 if x | y else 0)
    assert {r["in_c"] for r in rows[:200]} <= {1.0, None} and sum(r["in_c"] == 1.0 for r in rows[:200]) > 60


def test_likeness_is_near_the_exact_one_in_each_class_of_sizes(spark):
    """Whole sf0.01: edited texts against exact sets of shingles."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    got = {r["doc_id"]: r["near_edited"] for r in fingerprint.op4_document_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))}

    errors: dict[int, list[float]] = {0: [], 1: [], 2: []}
    for (i, t), (_, following) in zip(docs, docs[1:] + docs[:1]):
        quarter = len(t) // 4
        a, b = sets(t), sets(t[: len(t) - quarter] + following[:quarter])
        size = max(len(a), len(b))
        errors[0 if size <= fingerprint.SMALL else 1 if size <= 2 * fingerprint.SMALL else 2].append(abs(got[i] - (len(a & b) / len(a | b) if a | b else 1)))
    assert len(got) == len(docs) and all(len(e) > 30 for e in errors.values())
    assert max(errors[0]) < 0.01
    for e in errors.values():
        assert float(np.quantile(e, 0.99)) <= 0.1


def test_next_documents(spark, make):
    assert fingerprint.with_next(make([]).select("doc_id", "text")).count() == 0
    texts = [(i * 7 % 501, f"t{i}") for i in range(501)] + [(3, "again"), (3, None), (None, "x"), (None, "y")]
    rows = fingerprint.with_next(make(texts).select("doc_id", "text")).collect()
    ordered = sorted((i, t or "") for i, t in texts if i is not None)
    assert len(rows) == len(texts) and {(r["doc_id"], r["text"], r["next"]["text"]) for r in rows if r["next"]} == {(*x, y[1]) for x, y in zip(ordered, ordered[1:] + ordered[:1])}
    assert sum(r["next"] is None for r in rows) == 2


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    out = language_id.identify(docs.where(rest == 2), docs.where(rest != 2)).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_code_switched_words_and_texts_without_letters(spark, make):
    texts = [("the of and with that this for are from only " * 3, "en"), ("der die das nicht und mit von ist eine auch " * 3, "de"), ("le la les des une dans pour avec est sur " * 3, "fr")]
    model = language_id.fit(texts * 3, epochs=8)
    text = "the of and with that this for are der die das nicht und mit von ist"
    data = np.frombuffer(text.encode(), np.uint8)
    _, p = language_id.label_words(model, data, np.array([0, len(data)]))
    assert [model.labels[i] for i in p.argmax(axis=1)] == ["en"] * 8 + ["de"] * 8
    training = make([(i, t, lang, "s") for i, (t, lang) in enumerate(texts * 3)] + [(99, "x", None, "s")])
    rows = {r["doc_id"]: r for r in language_id.identify(make([(1, None), (2, "12 %"), (3, ""), (4, texts[1][0]), (5, "the of and " * 50_000)]), training).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "de", "en"] and rows[1]["score"] == 0
    assert language_id.identify(make([(1, "a b")]), make([])).first()["lang_pred"] == "und"
    assert language_id.identify(make([]), training).count() == 0


def test_forward_backward_is_exact():
    import itertools

    model = language_id.Crf(["a", "b", "c"])
    rng = np.random.default_rng(0)
    model.transition[:] = rng.normal(size=(3, 3))
    scores = rng.normal(size=(1, 4, 3)).astype(np.float32)
    weight = {path: math.exp(sum(scores[0, t, k] for t, k in enumerate(path)) + sum(model.transition[i, j] for i, j in zip(path, path[1:]))) for path in itertools.product(range(3), repeat=4)}
    for t in range(4):
        for k in range(3):
            assert model.marginals(scores)[0][0, t, k] == pytest.approx(sum(w for p, w in weight.items() if p[t] == k) / sum(weight.values()), rel=1e-3)
    lengths = [0, 1, 63, 64, 65, 0, 200, 500]
    first, many = np.concatenate([[0], np.cumsum(lengths)]), (3 * rng.normal(size=(sum(lengths), 3))).astype(np.float32)
    got = model.posteriors(many, first)
    for a, z in zip(first[:-1], first[1:]):
        if z > a:
            assert np.allclose(got[a:z], model.marginals(many[None, a:z])[0][0], atol=1e-4)
    assert model.posteriors(many[:0], np.array([0, 0])).shape == (0, 3)


def test_base_scores_and_training(spark, make, words):
    texts = [(i, words(60, i % 7) + (" The the of of " * 10)) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    counts = Counter(w for i, t in texts if i not in held for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    docs = make(texts)
    rows = lm_score.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = dict(texts)[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == n and r["n_tokens"] == len(tokens(text)) and r["n_known"] == sum(w in counts for w in tokens(text))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(text)))
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm_score.score(make([]), F.lit(False)).count() == 0
    assert lm_score.score(make([(1, "a b")]), F.lit(True)).first()["base_score"] == 0


def test_pair_hash_is_that_of_spark(spark):
    x = np.random.default_rng(0).integers(-(2**63), 2**63, (50, 2))
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "i int, a long, b long").select(F.xxhash64("a", "b").alias("h")).orderBy("i").collect()
    assert [r["h"] for r in rows] == lm_score.pair_hash(*x.astype(np.uint64).T).view(np.int64).tolist()


def test_scores_of_the_table_are_those_of_the_automaton(spark):
    """Whole sf0.001: the traversal of shares against one automaton of all kept n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), None]
    texts = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    training = [t for i, t in texts if not held(i)]
    counts = Counter(w for t in training for w in t)
    grams = [Counter(), Counter()]
    for t in training:
        grams[0].update(zip(t, t[1:]))
        grams[1].update(zip(t, t[1:], t[2:]))
    two, three = ({g: c for g, c in x.items() if c > 1} for x in grams)
    n, v = sum(counts.values()), len(counts)
    floor = math.log10(n + v + 1)
    p1 = {w: math.log10(c + 1) - floor for w, c in counts.items()}
    left, below, left2, below2 = Counter(), Counter(), Counter(), Counter()
    for (a, b), c in two.items():
        left[a] += c - 0.5
        below[a] += 10 ** p1[b]
    for (a, b, z), c in three.items():
        left2[a, b] += c - 0.5
        below2[a, b] += (two[b, z] - 0.5) / counts[b]
    back1 = {a: math.log10((1 - x / counts[a]) / (1 - below[a])) for a, x in left.items()}
    back2 = {g: math.log10((1 - x / two[g]) / (1 - below2[g])) for g, x in left2.items()}

    def of(t):
        total, state = 0.0, ()
        for w in t:
            if len(state) == 2 and (c := three.get((*state, w))):
                total, state = total + math.log10((c - 0.5) / two[state]), (state[1], w)
                continue
            if len(state) == 2:
                total, state = total + back2.get(state, 0.0), state[1:]
            if state and (c := two.get((*state, w))):
                total, state = total + math.log10((c - 0.5) / counts[state[0]]), (*state, w)
                continue
            total, state = total + (back1.get(state[0], 0.0) if state else 0.0) + p1.get(w, -floor), (w,)
        return total

    want = dict((i, of(t)) for i, t in texts)
    got = lm_score.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6, rel=1e-9)


def test_automaton_probabilities_sum_to_one(spark, make, words):
    text = words(400, 1).split()[:40] * 30
    h = np.sort(np.unique(np.array([zlib.crc32(w.encode()) for w in text], np.uint64)))
    ids = [int(np.searchsorted(h, zlib.crc32(w.encode()))) + 1 for w in text]
    base = lm_score.VOCABULARY + 2
    grams = Counter(a * base + b for a, b in zip(ids, ids[1:])) + Counter((a * base + b) * base + c for a, b, c in zip(ids, ids[1:], ids[2:]))
    count = np.array([ids.count(i + 1) for i in range(len(h))], np.int64)
    m = Automaton(h, count, len(ids), len(h), {g: c for g, c in grams.items() if c > 1})
    m.__setstate__(m.__dict__)
    unknown = 1 / (len(ids) + len(h) + 1)
    for before in ([], [ids[0]], ids[:2], ids[5:8]):
        total = sum(10 ** (m.traverse([*before, i]) - m.traverse(before)) for i in range(1, len(h) + 1))
        total += 10 ** (m.traverse([*before, 0]) - m.traverse(before)) * unknown
        assert total == pytest.approx(1, abs=1e-6)


def test_scores_are_those_of_the_automaton_of_all_words(make, words):
    rare = "one phrase of words that occur twice among very many others"
    texts = [(1, "x y " * 11_000), (2, rare), (3, rare), (4, "never seen " + rare + " seen never"), (5, words(300, 1) + " " + words(300, 1)), (6, words(200, 1)), (7, None), (8, "y"), (8, "y")]
    held = {4, 6}
    split = lambda t: [*(t or "").split(), None]
    training = [split(t) for i, t in texts if i not in held]
    counts = Counter(w for t in training for w in t)
    ids = {w: i for i, w in enumerate(counts, 1)}
    base = lm_score.VOCABULARY + 2
    grams = Counter()
    for t in training:
        x = [ids[w] for w in t]
        grams += Counter(a * base + b for a, b in zip(x, x[1:])) + Counter((a * base + b) * base + c for a, b, c in zip(x, x[1:], x[2:]))
    n, v = sum(counts.values()), len(counts)
    # The n-th word's hash is n, but for the end's: the last place of the vocabulary.
    last = ids.pop(None)
    swap = {last: v, v: last}
    place = lambda i: swap.get(i, i)
    digits = lambda g: [place(x) for x in (g // base // base, g // base % base, g % base) if x]
    moved = {}
    for g, c in grams.items():
        key = 0
        for x in digits(g):
            key = key * base + x
        if c > 1:
            moved[key] = c
    count = np.zeros(v, np.int64)
    for w, c in counts.items():
        count[place(last if w is None else ids[w]) - 1] = c
    m = Automaton(np.array([*range(1, v), lm_score.END], np.uint64), count, n, v, moved)
    m.__setstate__(m.__dict__)
    got = lm_score.score(make(texts), F.col("doc_id").isin(*held)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = split(dict(texts)[r["doc_id"]])
        x = [place(last if w is None else ids.get(w, 0)) for w in t]
        assert r["score"] == pytest.approx(m.traverse(x) - x.count(0) * math.log10(n + v + 1), abs=1e-6, rel=1e-9)
        assert r["n_known"] == len(x) - x.count(0)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["score"] > by_id[2]["base_score"] + 10


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.where(~held), rounds=1)
    out = quality.score(docs, model).join(labels.where(held), "doc_id").selectExpr("*", "quality = 1 and toxic = 0 as good").collect()
    right = lambda column: sum((r[column] >= 0.5) == r["good"] for r in out) / len(out)
    assert right("quality_score") >= 0.93 and right("content_score") >= 0.93 and right("metadata_score") >= 0.7
    assert sum(r["accepted"] for r in out if r["good"]) >= 0.97 * sum(r["good"] for r in out)
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_learns_toxic_words_and_repeats(spark, make, words):
    rows = [(i, words(80, i) + (" vile slur" if i % 3 == 0 else " good word")) for i in range(240)]
    labels = [(i, None if i % 3 == 0 else 1, 1 if i % 3 == 0 else None) for i in range(200)] + [(7, 1, 0), (500, 1, 1), (None, 1, 0), (3, None, None)]
    model = quality.fit(make(rows + rows[:5]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r["accepted"] for r in quality.score(make(rows + [(None, rows[0][1]), (900, None), (901, "word " * 200_000)]), model).collect()}
    assert len(out) == 243 and sum(out[i] == (i % 3 != 0) for i in range(200, 240)) >= 38 and out[None] is False


def test_logistic_regression_is_the_brute_force_one():
    rng = np.random.default_rng(0)
    on = rng.random((400, 6)) < 0.4
    y = (on @ np.array([2.0, -2, 1, 0, 0, 0]) + rng.normal(size=400) > 0.3).astype(float)
    rows, columns = np.nonzero(on)
    got = quality.fit_logistic(quality.Sparse(rows.astype(np.int32), columns.astype(np.int32), np.ones((400, 1)), 6), y, np.ones(400), steps=600)
    x, w = np.column_stack([on, np.ones(400)]).astype(float), np.zeros(7)
    for _ in range(50):  # Newton steps on the same loss
        p = quality.sigmoid(x @ w)
        ridge = np.diag([1.0] * 6 + [0.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert np.allclose(got, w, atol=0.1)


def test_quality_without_labels_accepts_all(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([(1, None), (2, ""), (2, ""), (None, "x " * 100_000)])
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 4 and all(r["accepted"] for r in out)
    assert quality.score(make([]), quality.fit(make([]), labels)).count() == 0


def test_texts_reach_the_filter_once_and_leave_it_in_slices(make):
    model = quality.Model()
    rows = [(i, f"{i} " + "word " * 90_000) for i in range(9)] + [(None, None)]
    kept = quality.keep_good(make(rows), model)
    given = kept._jdf.queryExecution().optimizedPlan().children().head().output()
    assert [given.apply(i).name() for i in range(given.size())].count("text") == 1
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(rows, key=repr)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def brute_contamination(texts, bench, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for name, item in bench:
            x = split(item)
            m = min(window, len(x))
            grams = {tuple(x[a : a + m]) for a in range(len(x) - m + 1)} if x else set()
            for a in range(len(w) - m + 1):
                if m and tuple(w[a : a + m]) in grams:
                    hit |= set(range(a, a + m))
                    found.add(str(name))
        yield i, len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1_000_000, 20, 1])
def test_contamination(spark, make, limit):
    import random

    rng = random.Random(1)
    line = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    bench = [(1, line(30)), (2, line(20) + " c"), (3, "a b"), (4, None), (5, "!"), (10, "One-off phrase, with accents é")]
    texts = [(i, line(rng.randint(1, 120))) for i in range(20)] + [(20, None), (21, ""), (22, "x ONE off phrase with accents é y"), (22, "c c"), (23, "z " * 5000 + bench[0][1])]
    got = decontaminate.contamination(make(texts), items(spark, [(i, t, "clash") for i, t in bench]), limit=limit).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(brute_contamination(texts, bench))
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_scan_of_an_unlucky_text_is_linear():
    import time

    one = np.full(40_000, 7, np.uint64)
    automaton = decontaminate.Automaton([("long", one), ("short", one[:3])], 13)
    start, found = time.process_time(), set()
    ends = [i for i, _ in automaton.matches([0] * 200_000, found)]
    assert len(ends) == 199_998 and found == {"long", "short"} and time.process_time() - start < 10


def test_decontaminate(spark, make, words):
    passage = words(40, 9)
    docs = make([(1, words(30, 1) + " " + passage + " " + words(30, 2)), (2, words(50, 3)), (3, None)])
    bench = items(spark, [(1, passage, "x")])
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, action="cut").collect()}
    assert passage not in cut[1] and cut[1].startswith(words(30, 1)) and cut[2] == words(50, 3)
    two = items(spark, [(1, passage, "x"), (2, words(30, 1), "y")])
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, two, action="cut", limit=5).collect()}[1].split() == words(30, 2).split()
    assert decontaminate.decontaminate(docs, two, limit=5).columns == docs.columns
    assert decontaminate.decontaminate(docs, items(spark, [])).count() == 3
    assert decontaminate.contamination(make([]), bench).count() == 0
