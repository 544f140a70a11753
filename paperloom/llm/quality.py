"""Quality classifier by co-training of a text view and a metadata view.

Each view has a logistic regression of its own: the text view over which words
a text has (hashed to ``BUCKETS`` places) and over measures of its characters and
repeats, all of them shares, so that a text's length is none of its features; the
metadata view over language, source and length. Over rounds, each view labels
the unlabelled documents that it is surest of, and the other learns from them
too. Both views are then calibrated on labelled documents that neither has
learnt from, and their calibrated log-odds are combined by a last regression on
the same.

A document is good when its quality label is 1 and its toxic label isn't. A
toxic label alone makes a document bad; a label with neither says nothing.

All texts are read whole. Features are made on the executors; the driver
gathers only integers and shares, of samples whose sizes are parameters: about
``LABELLED`` labelled documents (a fifth of them kept for calibration) and, each
round, about ``PSEUDO`` documents that a view has labelled. A sample is a share
of all rows by a seeded hash of the doc_id. In each round every document is
scored; sure ones of all of them stand for choice.

Defined results: null texts are empty; null languages and sources add nothing to
the metadata view; without labels, or with labels of one kind only, every
document is accepted with score 1; equal rows score alike; of rows that repeat a
doc_id one is learnt from; further columns are kept by ``keep_good``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import NOT_ALNUM, batch, discard, materialise, own_columns, read, slices, words

LABELLED = 12_000
PSEUDO = 2_000
BUCKETS = 1 << 18
META_BUCKETS = 1 << 14
ROUNDS = 2
#: How sure a view must be of a pseudo-label.
SURE = 0.95
PSEUDO_WEIGHT = 0.3
THRESHOLD = 0.5
SEED = 11
PAIRS = 1 << 20
STEPS, MORE_STEPS = 150, 40
#: A word of fewer training rows has no weight.
MIN_ROWS = 4


def _kinds() -> np.ndarray:
    """Kinds of bytes: letters of either case, digits, white space, bytes of other letters, controls, and each ASCII sign by itself."""
    kind = np.full(256, 5, np.int64)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\v\f")):
        kind[[ord(c) for c in chars]] = i
    kind[128:] = 4
    signs = [i for i in range(33, 127) if not chr(i).isalnum()]
    kind[signs] = 6 + np.arange(len(signs))
    return kind


KINDS = _kinds()
N_KINDS = int(KINDS.max()) + 1
MEASURES = 2 * N_KINDS + 4
#: Bytes of text whose features are made at once.
SLICE = 1 << 18


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row and place of each distinct word, measures by row) of runs of rows, over whole texts."""
    for first, upto, data, offsets in slices(column, SLICE):
        n, w = upto - first, words(data, offsets, NOT_ALNUM)
        pairs = np.unique(w.row * BUCKETS + (w.hash >> np.uint64(46)).astype(np.int64))
        row, place = pairs // BUCKETS, pairs % BUCKETS
        of_byte = np.repeat(np.arange(n), np.diff(offsets))
        share = np.bincount(of_byte * N_KINDS + KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS) / np.maximum(np.diff(offsets), 1)[:, None]
        count, size = np.maximum(np.diff(w.first), 1), w.end - w.start
        # Where a word repeats the one before it in its row.
        again = np.zeros(len(w.row), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
        other = [np.bincount(w.row, x, n) / count for x in (size / 10, size == 1, again)]
        yield first, n, row, place, np.column_stack([share * 20, np.sqrt(share) * 10, *other, np.ones(n)])


class Sparse:
    """Binary features by (row, column) pairs, and dense ones beside them."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, width: int):
        self.rows, self.columns, self.dense, self.width = rows, columns, dense, width

    def __len__(self):
        return len(self.dense)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.width :]
        for a in range(0, len(self.rows), PAIRS):  # a block at a time: few temporary arrays
            out += np.bincount(self.rows[a : a + PAIRS], weights[: self.width][self.columns[a : a + PAIRS]], len(self))
        return out

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a in range(0, len(self.rows), PAIRS):
            out += np.bincount(self.columns[a : a + PAIRS], error[self.rows[a : a + PAIRS]], self.width)
        return np.concatenate([out, self.dense.T @ error])

    def take(self, keep: np.ndarray) -> Sparse:
        place = np.full(len(self), -1, np.int32)
        place[keep] = np.arange(len(keep))
        inside = place[self.rows] >= 0
        return Sparse(place[self.rows][inside], self.columns[inside], self.dense[keep], self.width)

    def with_rows(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate([self.rows, other.rows + np.int32(len(self))]), np.concatenate([self.columns, other.columns]), np.concatenate([self.dense, other.dense]), self.width)

    def compact(self) -> tuple[Sparse, np.ndarray]:
        """The same rows over the columns that MIN_ROWS of them have, and which these are."""
        often = np.bincount(self.columns, minlength=self.width) >= MIN_ROWS
        keep, seen = often[self.columns], np.flatnonzero(often)
        return Sparse(self.rows[keep], np.searchsorted(seen, self.columns[keep]).astype(np.int32), self.dense, len(seen)), seen


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(full: Sparse, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None, steps: int = STEPS, l2: float = 1.0) -> np.ndarray:
    """Weights by full-batch steps of adaptive size, from ``start`` on; the last dense feature is the constant and isn't penalised."""
    x, seen = full.compact()
    at = np.concatenate([seen, full.width + np.arange(full.dense.shape[1])])
    whole = np.zeros(full.width + full.dense.shape[1]) if start is None else start.copy()
    out = whole[at]
    square, momentum = np.full_like(out, 1e-8), np.zeros_like(out)
    penalty = np.full_like(out, l2 / max(weight.sum(), 1))
    penalty[-1] = 0
    for step in range(steps):
        grad = x.gradient(weight * (sigmoid(x.dot(out)) - y)) / weight.sum() + penalty * out
        square = 0.95 * square + 0.05 * grad**2
        momentum = 0.8 * momentum + 0.2 * grad
        out -= 0.15 * (1 - step / steps) * momentum / (np.sqrt(square) + 1e-6)
    whole[at] = out
    return whole


def fit_pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A small logistic regression over dense columns, with a constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    out = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ out)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1]) * 1.0
        out -= np.linalg.solve(hessian, x.T @ (p - y) + out * 1.0)
    return out


class Model:
    """What scores documents: the views' weights, their calibrations and the combination of the two; trivial without any."""

    trivial = True

    def scores(self, text: pa.Array, langs: np.ndarray, sources: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view's, metadata view's, combined) probabilities of being good."""
        if self.trivial:
            return (np.ones(len(text)),) * 3
        content = np.concatenate([Sparse(row, place, dense, BUCKETS).dot(self.weights[0]) for _, _, row, place, dense in text_features(text)] or [np.zeros(0)])
        odds = [content, metadata(langs, sources, sizes).dot(self.weights[1])]
        odds = [o * c[0] + c[1] for o, c in zip(odds, self.calibration, strict=True)]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(np.column_stack([*odds, np.ones(len(content))]) @ self.combination)


def metadata(langs: np.ndarray, sources: np.ndarray, sizes: np.ndarray) -> Sparse:
    """The metadata view of rows: places of language and source (-1: none), and the length's logarithm."""
    rows = np.concatenate([np.flatnonzero(langs >= 0), np.flatnonzero(sources >= 0)]).astype(np.int32)
    places = np.concatenate([langs[langs >= 0], sources[sources >= 0] + META_BUCKETS])
    size = np.log1p(np.maximum(sizes, 0)) / 5
    return Sparse(rows, places, np.column_stack([size, size**2, np.ones(len(size))]), 2 * META_BUCKETS)


class CoTrained(Model):
    """A model under training; each view keeps the rows that the other has labelled for it beside those labelled from the start."""

    def __init__(self, views: list[Sparse], good: np.ndarray, seed: int):
        order = np.random.default_rng(seed).permutation(len(good))
        held, learn = order[: len(order) // 5], order[len(order) // 5 :]
        if len(held) < 5 or any(len(np.unique(good[x])) < 2 for x in (held, learn)):
            return
        self.trivial = False
        self.held, self.truth = [v.take(held) for v in views], good[held]
        self.x, self.y, self.w = [v.take(learn) for v in views], [good[learn]] * 2, [np.ones(len(learn))] * 2
        self.weights = [None, None]
        self.fit(STEPS)

    def fit(self, steps: int) -> None:
        self.weights = [fit_logistic(*z, steps=steps) for z in zip(self.x, self.y, self.w, self.weights, strict=True)]
        odds = [x.dot(w) for x, w in zip(self.held, self.weights, strict=True)]
        self.calibration = [fit_pair(o[:, None], self.truth) for o in odds]
        self.combination = fit_pair(np.column_stack([o * c[0] + c[1] for o, c in zip(odds, self.calibration, strict=True)]), self.truth)

    def told(self, view: int, rows: Sparse, good: np.ndarray) -> None:
        """Gives a view rows that the other has labelled, in place of those of the round before."""
        n = int((self.w[view] == 1).sum())
        self.x[view] = self.x[view].take(np.arange(n)).with_rows(rows)
        self.y[view] = np.concatenate([self.y[view][:n], good])
        self.w[view] = np.concatenate([np.ones(n), np.full(len(good), PSEUDO_WEIGHT)])

    def model(self) -> Model:
        """The model without its training rows."""
        out = Model()
        out.trivial = self.trivial
        if not self.trivial:
            out.weights, out.calibration, out.combination = [w.astype(np.float32) for w in self.weights], self.calibration, self.combination
        return out


def _place(column: str) -> Column:
    """A value's place by its hash, -1 for null."""
    return F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(column), F.lit(META_BUCKETS))).otherwise(-1).cast("int")


def _inputs() -> list[Column]:
    """What the features are made of: text, places of language and source, length."""
    return [F.col("text"), _place("lang"), _place("source"), F.coalesce("n_chars", F.lit(0)).cast("long")]


def _known(docs: DataFrame) -> DataFrame:
    return own_columns(docs, "doc_id", "text", "lang", "source", "n_chars")


def _gathered(rows: DataFrame, answer: str) -> tuple[list[Sparse], np.ndarray]:
    """Both views' features of a bounded number of rows, and their answers. Integers and shares reach the driver, no text does."""
    schema = pa.schema([("doc_id", pa.int64()), ("answer", pa.float64()), ("places", pa.binary()), ("measures", pa.binary()), ("lang", pa.int32()), ("source", pa.int32()), ("size", pa.int64())])

    def make(batches):
        for b in batches:
            for first, n, row, place, dense in text_features(b.column(2)):
                bounds = np.searchsorted(row, np.arange(n + 1))
                place = place.astype(np.int32)
                yield batch(schema, b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array([place[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in dense], pa.binary()), *[b.column(i).slice(first, n) for i in (3, 4, 5)])

    made = rows.select("doc_id", F.col(answer).cast("double"), *_inputs()).mapInArrow(make, "doc_id long, answer double, places binary, measures binary, lang int, source int, size long")
    one = made.groupBy("doc_id").agg(F.min(F.struct("answer", "places", "measures", "lang", "source", "size")).alias("r")).select("doc_id", "r.*")
    found = sorted(one.collect(), key=lambda r: r["doc_id"])
    places = [np.frombuffer(r["places"], np.int32) for r in found]
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(p) for p in places]) if found else np.zeros(0, np.int32)
    content = Sparse(rows, np.concatenate(places) if found else np.zeros(0, np.int32), np.array([np.frombuffer(r["measures"]) for r in found]).reshape(-1, MEASURES), BUCKETS)
    del places
    meta = metadata(*[np.array([r[c] for r in found], np.int64) for c in ("lang", "source", "size")])
    return [content, meta], np.array([r["answer"] for r in found], float)


def _share(n: int, of: int, seed: int) -> Column:
    """Whether a doc_id is among about n of so many, by a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 40)))


def fit(docs: DataFrame, labels: DataFrame, seed: int = SEED, rounds: int = ROUNDS) -> Model:
    """The co-trained model; a document with several labels is good only if all say so."""
    good = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("int"))
    one = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good")).where("good is not null")
    one = materialise(one, "quality-labels")
    known = _known(docs)
    views, answers = _gathered(known.join(F.broadcast(one.where(_share(LABELLED, one.count(), seed))), "doc_id"), "good")
    trained = CoTrained(views, answers, seed)
    del views
    for turn in range(0 if trained.trivial else rounds):
        # Scores of all documents; what is kept of them are those that a view is sure of and nobody has labelled.
        sure = _scored(known, trained.model()).where("doc_id is not null").select("doc_id", *[F.when(F.greatest(F.col(c), 1 - F.col(c)) >= SURE, (F.col(c) >= 0.5).cast("int")).alias(c) for c in ("content", "meta")])
        sure = materialise(sure.where("content is not null or meta is not null").join(one.hint("merge"), "doc_id", "left_anti"), "quality-sure")
        n = sure.agg(F.count("content").alias("content"), F.count("meta").alias("meta")).first()
        for giver, taker in ((0, 1), (1, 0)):
            side = ("content", "meta")[giver]
            chosen = sure.where(F.col(side).isNotNull() & _share(PSEUDO, n[side], seed + 1 + 2 * turn + giver)).select("doc_id", F.col(side).alias("told"))
            views, answers = _gathered(known.join(F.broadcast(chosen), "doc_id"), "told")
            trained.told(taker, views[taker], answers)
        discard(sure)
        trained.fit(MORE_STEPS)
    discard(one)
    return trained.model()


def _scored(known: DataFrame, model: Model) -> DataFrame:
    """doc_id, content, meta and both: probabilities of being good."""
    shared = known.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.float64()), ("meta", pa.float64()), ("both", pa.float64())])

    def judge(batches):
        for b in batches:
            yield batch(schema, b.column(0), *shared.value.scores(b.column(1), *[b.column(i).to_numpy() for i in (2, 3, 4)]))

    return known.select("doc_id", *_inputs()).mapInArrow(judge, "doc_id long, content double, meta double, both double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, content_score, metadata_score, quality_score (probabilities of being good) and accepted."""
    return _scored(_known(docs), model).select("doc_id", F.col("content").alias("content_score"), F.col("meta").alias("metadata_score"), F.col("both").alias("quality_score"), (F.col("both") >= THRESHOLD).alias("accepted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier accepts, with all their columns. A text reaches a task once, and what is kept leaves it a slice at a time."""
    shared, n, text = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns), docs.columns.index("text")

    def keep(batches):
        for b in batches:
            for row, upto, _, _ in slices(b.column(text)):
                part = b.slice(row, upto - row)
                q = shared.value.scores(part.column(text), *[part.column(n + i).to_numpy() for i in range(3)])[2]
                yield part.select(range(n)).filter(pa.array(q >= THRESHOLD))

    return docs.select("*", *_inputs()[1:]).mapInArrow(keep, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
