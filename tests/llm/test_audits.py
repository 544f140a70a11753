"""Periodic runs, SimHash near-duplicates and the filter audit, against brute force."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import filter_audit, periodic_runs, simhash

WORD = r"[^\x20\x09-\x0D]+"


def word_ids(texts):
    split = [re.findall(WORD, t or "") for t in texts]
    number = {}
    return np.array([number.setdefault(w, len(number)) for t in split for w in t], np.int64), np.cumsum([0, *map(len, split)])


def brute_runs(w, repeats=4, least=6):
    """(start, length, period) by trying all stretches of each period, smallest first."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def runs_by_text(texts, **more):
    ids, first = word_ids(texts)
    found = periodic_runs.runs(ids, first, **more)
    return [[(s - a, e - s, p) for s, e, p in found.tolist() if a <= s < z] for a, z in zip(first[:-1], first[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=5))
def test_runs_of_two_words(texts):
    assert runs_by_text([" ".join(t) for t in texts]) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("seed", range(25))
def test_runs_of_loops(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        t = []
        while len(t) < 300:
            loop = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
            t += (loop * 30)[: rng.randint(1, 90)]
        texts.append(t)
    assert runs_by_text([" ".join(t) for t in texts]) == [brute_runs(t) for t in texts]
    assert runs_by_text([" ".join(t) for t in texts], repeats=3, least=5) == [brute_runs(t, 3, 5) for t in texts]


def test_grid_in_small_blocks():
    ids, first = word_ids(["a b " * 50, "c " * 70, "x y z"])
    whole = [np.concatenate(c).tolist() for c in zip(*periodic_runs.grid(ids, first))]
    assert [np.concatenate(c).tolist() for c in zip(*periodic_runs.grid(ids, first, block=16))] == whole


def test_periodic_runs(make, words):
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a A a A a A a", "p q r " * 4 + "p q", words(20_000, 1), "w " * 30_000, words(300, 2) + " " + "x y z é " * 20 + words(200, 3), "a\x0bb\x0ca\x0db\ta\nb a b"]
    rows = [*enumerate(texts), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b b b b b b b")]
    got = periodic_runs.periodic_runs(make(rows)).collect()
    expected = []
    for i, t in rows:
        w = re.findall(WORD, t or "")
        found = brute_runs(w) if len(w) < 2000 else ([(0, len(w), 1)] if len(set(w)) == 1 else [])
        expected.append((i, len(w), found, brute_collapsed(w, found)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr) == sorted(expected, key=repr)
    assert periodic_runs.periodic_runs(make([])).count() == 0


def test_looped_ids_and_digests(spark, make, words, tmp_path):
    rows = [(i, words(1 + i % 90, i)) for i in range(300)] + [(None, "c c c c c c c"), (301, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    import zlib

    for i, t in rows:
        w = re.findall(WORD, t or "")
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found, r = brute_runs(w), got[i]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(w, found).encode()).hexdigest()


def brute_fingerprint(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, bits=2):
    """id -> least id that links reach; fps: (id, fingerprint)."""
    label = {i: i for i, _ in fps}
    find = lambda i: i if label[i] == i else find(label[i])
    for (a, x), (b, y) in itertools.combinations(fps, 2):
        if (x ^ y).bit_count() <= bits:
            low, high = sorted((find(a), find(b)))
            label[high] = low
    return {i: find(i) for i in label}


def test_simhash(make, words):
    rng = random.Random(5)
    base = words(400, 1).split()
    texts = [" ".join(base)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", "  ", "One two", "one TWO", "É a", "é a", "one two three", words(30_000, 8), words(30_000, 8) + " x", *[words(12, s) for s in range(10, 60)], texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(make(rows)).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    groups = brute_groups(fps)
    assert got == {i: (f, groups[i]) for i, f in fps}
    assert len(set(groups.values())) < len(rows) - 20


def test_simhash_edges(make):
    assert simhash.near_duplicates(make([])).count() == 0
    rows = simhash.near_duplicates(make([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "other words of its own"), (9, None), (8, "")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (8, 8), (9, 8)]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_stretches_change_nothing(size, monkeypatch, words):
    text = ("  " + words(200, 4) + " A\x0bB\n" + "long" * 50 + " ").encode()
    monkeypatch.setattr(simhash, "STRETCH", size)
    assert [w for s in simhash.stretches(text, size) for w in s] == text.split()
    monkeypatch.setattr(simhash.stretches, "__defaults__", (size,))
    assert simhash.fingerprint(text) == brute_fingerprint(text.decode())


def test_links_of_a_full_ball(spark):
    """Thousands of fingerprints around one, with any number of different bits, and scattered ones."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6]))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(300)} | {0, 3, (1 << 64) - 1, (1 << 64) - 1 ^ 1 << 63}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.index_links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    label = {signed(x): signed(x) for x in fps}
    find = lambda i: i if label[i] == i else find(label[i])
    for r in links:
        x, y = sorted((find(r["a"]), find(r["b"])))
        label[y] = x
    groups = brute_groups([(signed(x), x) for x in fps])
    assert {i: find(i) for i in label} == groups


def walked(masks, names):
    """Removed by each filter, summed over all orders, by walking each over the documents."""
    out = dict.fromkeys(names, 0)
    for order in itertools.permutations(names):
        left = list(masks)
        for x in order:
            out[x] += sum(x in m for m in left)
            left = [m for m in left if x not in m]
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.frozensets(st.sampled_from("ABCDE")), max_size=30))
def test_shapley_is_the_mean_over_orders(masks):
    counts = {m: masks.count(m) for m in set(masks)}
    poly = filter_audit.polynomial(counts)
    assert {x: filter_audit.shapley(poly, x) * 120 for x in "ABCDE"} == walked(masks, "ABCDE")
    for size in range(6):
        for on in itertools.combinations("ABCDE", size):
            assert filter_audit.corner(poly, on) == sum(bool(m & set(on)) for m in masks)
    assert sum(filter_audit.shapley(poly, x) for x in "ABCDE") == Fraction(filter_audit.corner(poly, "ABCDE"))


def test_audit_edges(spark, make, words):
    long = words(150, 1)
    docs = [(1, long), (2, long), (2, long), (1, long), (None, long), (None, long), (3, None, None), (4, "", "de"), (5, "SHOUT $", "de"), (6, "w " * 30_000, "fr"), (7, long + " #", "")]
    labels = spark.createDataFrame([(2, 1, 0, "x"), (2, 0, 1, "x"), (3, None, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(make(docs), labels).collect()}
    assert len(got) == 600 * len({(d[2] if len(d) > 2 else "en") or "" for d in docs})
    e = got["en", "EABCD", 1]
    assert (e["kept"], e["removed"], e["redundant"], e["unique_fails"], e["good_lost"], e["toxic_lost"], e["shapley"]) == (4, 2, 0, 2, 2, 2, 240)
    b = got["fr", "BACDE", 1]
    assert (b["kept"], b["removed"], b["shapley"]) == (0, 1, 120)
    assert got["de", "AEBCD", 1]["removed"] == 2 and got["de", "AEBCD", 2]["redundant"] == 1
    assert filter_audit.audit(make([]), labels).count() == 0
    assert filter_audit.audit(make(docs), labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0
