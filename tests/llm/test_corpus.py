"""Operators across documents: mixing, joins and duplicates, and the pipeline."""

import itertools
import re

import numpy as np
import pytest

from paperloom.llm import compact_windows, jaccard, mixing, suffix_dedup
from paperloom.llm.components import components

SF = "/root/testdata/sf0.001"


def level_targets(sizes, share=1.5, weights=(3, 1, 2)):
    """Targets by the rule as it is stated: cap, reshare the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: per * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(make, words):
    rows = [(i, words(1 + i % 37, i), "en", ["a", "b", "É", None, "z"][min(i % 11, 4)]) for i in range(300)] + [(300, None, "en", "a"), (301, "", "en", "empty"), (302, "w " * 30_000, "en", "b"), (5, words(6, 5), "en", "z")]
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] is not None
    expected = level_targets(sizes)
    lengths = lambda s: [r["size"] for r in got if r["source"] == s]
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - round(target[s])) == min(abs(x - (round(target[s]) - whole * sizes[s])) for x in subset_sums(lengths(s)))
    again = mixing.mix(make(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(make([])).count() == 0


def subset_sums(lengths):
    """All sums of some of the lengths, as a set, by shifts of a bit string."""
    bits = 1
    for n in lengths:
        bits |= bits << n
    return {i for i, c in enumerate(reversed(bin(bits)[2:])) if c == "1"}


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_the_nearest_sum(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.array(sorted(rng.choice(np.arange(3, 40), 4, replace=False))), rng.integers(1, 4, 4)
    budget = int(rng.integers(0, (lengths * counts).sum() + 1))
    took = mixing.fit(lengths, counts, budget)
    assert (took <= counts).all() and (took >= 0).all()
    assert abs((took * lengths).sum() - budget) == min(abs(x - budget) for x in subset_sums(np.repeat(lengths, counts).tolist()))


@pytest.mark.parametrize(("lengths", "counts", "budget", "best"), [([80000, 1], [1, 50000], 99000, 99000), ([100, 7], [1, 10], 149, 149), ([30000], [1], 29999, 30000), ([0, 5], [9, 3], 7, 5), ([], [], 0, 0)])
def test_fit_from_both_sides(lengths, counts, budget, best):
    assert (mixing.fit(np.array(lengths, np.int64), np.array(counts, np.int64), budget) * np.array(lengths, np.int64)).sum() == best


def test_fit_beyond_the_table_keeps_the_mix_of_lengths():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(1, 2001), rng.integers(1, 500, 2000)
    budget = int((lengths * counts).sum() * 0.4) + 1
    took = mixing.fit(lengths, counts, budget, limit=1 << 16)
    assert (took <= counts).all() and (took * lengths).sum() == budget
    short, long = (took[x].sum() / counts[x].sum() for x in (slice(0, 1000), slice(1000, 2000)))
    assert abs(short - long) < 0.05


def brute_components(texts, size=4, percent=85):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(words, n, base_seed, length, edits):
    import random

    rng, base = random.Random(base_seed), words(length, base_seed).split()
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"edit{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard(make, words, size, percent):
    texts = [t for seed, n in ((1, 25), (2, 12), (3, 4)) for t in near_copies(words, n, seed, 60 + 40 * seed, 6)]
    texts += [None, "", "  ", "One two", "one TWO", "one two three", "a b c d", "A b c d", words(20_000, 8), words(20_000, 8) + " x", *[words(10, s) + " same line for all of these documents here" for s in range(10, 30)]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(make(rows), size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_jaccard_edges(make):
    assert jaccard.join(make([])).count() == 0
    rows = jaccard.join(make([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "other words of its own"), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (9, 9)]


def test_jaccard_links_are_all_counted(make, words):
    texts = [*near_copies(words, 40, 1, 80, 4), *[words(30, 5)] * 3, words(30, 5) + " x", None, "one two"]
    shingled = [{tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if (w := (t or "").split()) else set() for t in texts]
    alike = lambda x, y: x and 100 * len(x & y) >= 85 * len(x | y)
    rows = [*enumerate(texts), (None, texts[0])]
    got = {r["doc_id"]: r for r in jaccard.join(make(rows)).collect()}
    assert {i: got[i]["n_links"] for i in range(len(texts))} == {i: sum(bool(alike(x, y)) for j, y in enumerate(shingled) if i != j) for i, x in enumerate(shingled)}
    assert max(r["n_links"] for r in got.values()) > 8 and got[None]["n_links"] == 0
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(make(rows)).collect()} == {i: r["component_id"] for i, r in got.items()}


def rows_made(df, node):
    """The rows that the operators of a name have made, once ``df`` was collected."""
    open_, out = [df._jdf.queryExecution().executedPlan()], []
    while open_:
        p = open_.pop()
        if p.nodeName() == node:
            out.append(p.metrics().apply("numOutputRows").value())
        open_ += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_a_pair_is_made_once_whatever_it_shares(make, words):
    texts = list(near_copies(words, 60, 1, 200, 6))
    _, _, posted = jaccard._classed(make(list(enumerate(texts))), 4, 85, jaccard.MATCHES)
    pairs = jaccard.all_pairs(jaccard._labelled(posted, None), 85, jaccard.MATCHES).hint("merge")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) > 100
    assert max(rows_made(pairs, "SortMergeJoin") + rows_made(pairs, "BroadcastHashJoin")) == len(got)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 105)}


def brute_removals(texts):
    first, out = {}, {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in texts:
        b = (t or "").encode()
        gone = {j for k in range(len(b) - 49) if first[b[k : k + 50]] < i for j in range(k, k + 50)}
        out[i] = (len(b), len(gone), sum(j - 1 not in gone for j in gone))
    return out


def test_suffix_dedup(make, words):
    shared = [words(14, s) for s in range(5)]
    texts = [(i, " ".join([words(12, 50 + i), shared[i % 5][: 40 + i], words(9, 90 + i), shared[(i * 3) % 5], "é" * (i % 30)])) for i in range(40)]
    texts += [(40, texts[3][1]), (41, texts[3][1]), (42, None), (43, ""), (44, "x" * 300), (45, "y" + "x" * 120), (46, "short"), (47, words(3000, 1)), (48, words(3000, 1)[500:9000])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.removals(make(texts)).collect()}
    assert got == brute_removals(texts)


def test_suffixes_are_compared_across_blocks(make, words, monkeypatch):
    hot = words(9, 3)
    rows = [(i, f"{words(4, 100 + i % 23)} {hot} {words(4, 200 + i % 17)}") for i in range(300)] + [(300 + i, hot * 3 + "z" * i) for i in range(40)]
    kept, compared = suffix_dedup._compared, []
    monkeypatch.setattr(suffix_dedup, "_compared", lambda *x: compared.append(1) or kept(*x, block=7))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.removals(make(rows)).collect()}
    assert compared and got == brute_removals(rows)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, n, 20_000).astype(np.uint64) for n in (3, 1 << 40, 5, 2)]
    keys[1][:9000] = 7
    assert (np.stack(keys)[:, suffix_dedup.multikey_quicksort(keys)] == np.stack(keys)[:, np.lexsort(keys[::-1])]).all()


def test_suffix_dedup_edges(make, words):
    long = words(60, 1)
    rows = suffix_dedup.removals(make([(1, long), (1, long), (None, long), (2, long), (2, "x" + long)])).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (1, 0), (1, 0), (2, len(long)), (2, len(long))]
    assert suffix_dedup.removals(make([])).count() == 0
    kept = suffix_dedup.dedup(make([(1, long), (2, long), (3, long + " and more"), (4, None)]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}.keys() == {1, 3} | ({4} if any(r["doc_id"] == 4 for r in kept.collect()) else set())
    assert "text" in kept.columns and "places" in kept.columns


def test_compact_windows_cover_every_subsequence():
    values = np.random.default_rng(0).permutation(60).astype(np.uint64)
    windows = compact_windows.compact_windows(values, 8)
    for x in range(60):
        for y in range(x + 7, 60):
            assert sum(a <= x <= c <= y <= z for a, c, z in windows) == 1
            assert any(a <= x <= c <= y <= z and values[c] == values[x : y + 1].min() for a, c, z in windows)


def test_passages(make, words):
    passage = words(70, 7)
    near = passage.split()
    near[30] = "changed"
    texts = [(1, f"{words(40, 1)} {passage} {words(40, 2)}"), (2, f"{words(30, 3)} {passage}"), (3, f"{' '.join(near)} {words(50, 4)}"), (4, words(200, 5)), (5, words(200, 5)), (6, None), (7, "short"), (8, words(120, 6)), (None, passage)]
    rows = compact_windows.passages(make(texts)).collect()
    linked = {(r["first_doc"], r["doc_id"]) for r in rows}
    assert (1, 2) in linked and {x for p in linked for x in p} == {1, 2, 3, 4, 5} and (4, 5) in linked
    found = next(r for r in rows if (r["first_doc"], r["doc_id"]) == (1, 2))
    assert (found["first_start"], found["first_end"], found["start_word"], found["end_word"]) == (40, 110, 30, 100) and found["similarity"] == 1.0
    assert compact_windows.passages(make([])).count() == 0


def linked_groups(rows):
    """A function from a document to its group by the passages found."""
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for r in rows:
        label[find(r["doc_id"])] = find(r["first_doc"])
    return find


def test_common_phrases_do_not_hide_copied_passages(make, words):
    from paperloom.llm.common import flat, mix, shingles
    from paperloom.llm.common import words as split

    import pyarrow as pa

    passage = words(60, 1)
    h, _ = shingles(split(*flat(pa.array([passage]))), 5)
    phrases = {int(i) for salt in compact_windows.SALTS[: compact_windows.HASHES] for i in np.argsort(mix(h ^ np.uint64(salt)))[:10]}
    rows, decoy = [(5000, f"{words(30, 2)} {passage} {words(30, 3)}"), (50000, f"{words(25, 4)} {passage} {words(40, 5)}")], 0
    for i in sorted(phrases):
        for _ in range(12):
            decoy += 1
            rows.append((decoy if decoy % 2 else 6000 + decoy, f"{words(50, 1000 + decoy)} {' '.join(passage.split()[i : i + 5])} {words(50, 9000 + decoy)}"))
    got = compact_windows.passages(make(rows).coalesce(1)).collect()
    assert {(r["first_doc"], r["doc_id"]) for r in got} == {(5000, 50000)}


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_copies_are_found(make, words, parts):
    import random

    rng, rows = random.Random(5), []
    for group in range(12):
        base = words(90, group).split()
        for copy in range(5):
            w = list(base)
            for at in range(10 + 8 * copy, 90, 60):
                w[at] = f"edit{rng.randrange(10**6)}"
            rows.append((group * 5 + copy, " ".join(w)))
    got = compact_windows.passages(make(rows).repartition(parts)).collect()
    find = linked_groups(got)
    pairs = [(g * 5 + i, g * 5 + j) for g in range(12) for i, j in itertools.combinations(range(5), 2)]
    assert sum(find(i) == find(j) for i, j in pairs) >= 0.9 * len(pairs)
    assert all(r["doc_id"] // 5 == r["first_doc"] // 5 and r["similarity"] >= 0.8 for r in got)


def test_edited_cuts_of_many_groups_all_link(make, words):
    import random

    rng, rows = random.Random(11), []
    bases = [words(400, 700 + g).split() for g in range(6)]
    for i in range(300):
        at = rng.randrange(0, 300)
        w = bases[i % 6][at : at + 100]
        w[rng.randrange(100)] = f"edit{i}"
        rows.append((i, at, f"{words(20, 3000 + i)} {' '.join(w)} {words(20, 6000 + i)}"))
    got = compact_windows.passages(make([(i, t) for i, _, t in rows]).repartition(5)).collect()
    find = linked_groups(got)
    # Cuts whose overlap is nine tenths of each are near-duplicates even with an edit each; neighbours of a text chain through them.
    pairs = [(i, j) for (i, p, _), (j, q, _) in itertools.combinations(rows, 2) if i % 6 == j % 6 and abs(p - q) <= 10]
    assert len(pairs) > 400 and all(find(i) == find(j) for i, j in pairs)
    assert all(r["doc_id"] % 6 == r["first_doc"] % 6 for r in got)


def test_different_near_copies_all_meet(make, words):
    texts = list(near_copies(words, 40, 21, 160, 2))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = {(i, j) for i, j in itertools.combinations(range(40), 2) if texts[i] != texts[j] and texts[i] not in texts[:i] and texts[j] not in texts[:j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(r["first_doc"], r["doc_id"]) for r in compact_windows.passages(make(enumerate(texts)).repartition(3)).collect()}
    assert len(pairs) > 200 and len(pairs & got) >= 0.95 * len(pairs)


def test_batches_hold_every_pair_once(make, words, monkeypatch):
    rows = make(enumerate(near_copies(words, 10, 21, 160, 2))).repartition(3)
    whole, labels, write = compact_windows.passages(rows).collect(), [], compact_windows.materialise
    monkeypatch.setattr(compact_windows, "PAIRS_AT_ONCE", 0.7)
    monkeypatch.setattr(compact_windows, "BYTES_AT_ONCE", 12)
    monkeypatch.setattr(compact_windows, "materialise", lambda df, label, *more: labels.append(label) or write(df, label, *more))
    got = compact_windows.passages(rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(got) > 5
    assert labels.count("windows-rest") > 1 and labels.count("windows-further") > 1


def test_no_place_is_filled_before_a_link(make, words):
    passage = words(70, 31)
    phrase = " ".join(passage.split()[20:40])
    rows = [(i, f"{words(40, 4000 + i)} {phrase} {words(40, 7000 + i)}") for i in range(40)]
    w = passage.split()
    w[5] = "changed"
    rows += [(100, f"{words(30, 32)} {passage} {words(30, 33)}"), (200, f"{words(30, 34)} {' '.join(w)} {words(30, 35)}"), (150, f"{words(30, 36)} {phrase} {words(60, 37)}")]
    got = compact_windows.passages(make(rows).repartition(3)).collect()
    assert {(r["first_doc"], r["doc_id"]) for r in got} == {(100, 200)}


def test_recall_of_shared_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    find = linked_groups(compact_windows.passages(docs).collect())
    runs = {}
    for i, t in ((r["doc_id"], r["text"]) for r in docs.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for k in range(len(w) - 49):
            runs.setdefault(" ".join(w[k : k + 50]), set()).add(i)
    pairs = {p for ids in runs.values() for p in itertools.combinations(sorted(ids), 2)}
    assert len(pairs) > 20 and sum(find(a) == find(b) for a, b in pairs) >= 0.95 * len(pairs)


def test_windows_of_repeated_phrases_are_few():
    import time

    start = time.process_time()
    assert len(compact_windows.compact_windows(np.zeros(200_000, np.uint64), 46)) == 1
    assert len(compact_windows.compact_windows(np.tile(np.arange(60, dtype=np.uint64), 3000), 46)) <= 14 * 3001 and time.process_time() - start < 10


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "mixing sources"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * total) < 0.05 * total
    out = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    groups = {i: c for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80).items()}
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(groups.values()))
