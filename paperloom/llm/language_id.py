"""Language identification of words by a linear-chain conditional random field.

A word's features are its affixes of one to three bytes, its byte trigrams and
the word itself (the lexicon), all hashed into weight tables per language;
learned transitions join the words' labels to a chain. The model is fitted on a
bounded sample of labelled documents (about ``PER_LANGUAGE`` whole texts a
language, a share by a seeded hash): their words are strung together in runs of
changing languages, so that the transitions are those of code-switched text. All
words of all texts are then labelled by forward-backward, a text being one chain
however long it is, and a document's language is the one with most expected words.

Defined results: null texts and texts without a letter are ``und`` with score 0,
and so is every text if nothing is labelled; of equally likely languages the
first in code-point order is taken; texts alone decide, so repeated rows get
equal results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, batch, own_columns, prefix_hash, range_hash, read, slices, words

PER_LANGUAGE = 400
#: Words of a stretch of a chain: stretches are worked on side by side, and messages pass between them.
CHAIN = 64
TABLE = 1 << 17
EPOCHS = 4
STEP = 24
SEED = 5
AFFIXES = (1, 2, 3)


def _affixes(data: np.ndarray, w) -> np.ndarray:
    """Table places of each word's lexicon entry, prefixes and suffixes."""
    prefix = prefix_hash(LOWER[data])
    places = [w.hash]
    for n in AFFIXES:
        places.append(range_hash(prefix, w.start, np.minimum(w.start + n, w.end)) + np.uint64(n))
        places.append(range_hash(prefix, np.maximum(w.end - n, w.start), w.end) + np.uint64(16 + n))
    return np.stack([(p * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int64) for p in places], axis=1)


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The table place of the three bytes from each byte on (the last two are padded)."""
    b = np.concatenate([LOWER[data], np.zeros(2, np.uint8)]).astype(np.int64)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 0x9E3779B1 >> 7) % TABLE


class Crf:
    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.affix, self.trigram = np.zeros((TABLE, k), np.float32), np.zeros((TABLE, k), np.float32)
        self.transition = np.zeros((k, k), np.float32)

    def emissions(self, data: np.ndarray, w) -> np.ndarray:
        """Scores of each word for each language."""
        out = np.zeros((len(w.start), len(self.labels)), np.float32)
        places = _affixes(data, w)
        for j in range(places.shape[1]):
            out += self.affix[places[:, j]]
        sums = np.zeros((len(data) + 1, len(self.labels)))
        np.cumsum(self.trigram[_trigrams(data)], axis=0, out=sums[1:])
        return out + (sums[np.maximum(w.end - 2, w.start)] - sums[w.start]).astype(np.float32)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chains, words, labels) scores -> posteriors of labels, and of label pairs summed over all words."""
        move = np.exp(self.transition)
        emit = np.exp(scores - scores.max(axis=2, keepdims=True))
        n, steps, k = emit.shape
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        f = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        forward[:, 0] = f
        for t in range(1, steps):
            f = (f @ move) * emit[:, t]
            f /= f.sum(axis=1, keepdims=True)
            forward[:, t] = f
        r = np.full((n, k), 1 / k, np.float32)
        backward[:, -1] = r
        pairs = np.zeros((k, k))
        for t in range(steps - 1, 0, -1):
            r = r * emit[:, t]
            both = forward[:, t - 1, :, None] * move * r[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            r = r @ move.T
            r /= r.sum(axis=1, keepdims=True)
            backward[:, t - 1] = r
        out = forward * backward
        return out / out.sum(axis=2, keepdims=True), pairs

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The posteriors of chains one after the other: words first[r]:first[r + 1] of the scores are the r-th.

        Chains are cut into stretches. What a stretch does to a message is a
        matrix; by these the messages at all cuts are found, and the words
        inside the stretches after that.
        """
        move, k = np.exp(self.transition), scores.shape[1]
        counts = np.diff(first)
        n = -(-counts // CHAIN)
        at = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(row)) - first[row] + at[row] * CHAIN
        emit, real = np.ones((at[-1] * CHAIN, k), np.float32), np.zeros(at[-1] * CHAIN, bool)
        emit[place], real[place] = np.exp(scores - scores.max(axis=1, keepdims=True, initial=-np.inf)), True
        emit, real = emit.reshape(-1, CHAIN, k), real.reshape(-1, CHAIN)
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        forward, before, after = np.empty_like(emit), np.ones((len(emit), k), np.float32), np.ones((len(emit), k), np.float32)

        def onward(which: np.ndarray, f: np.ndarray, begun: bool) -> None:
            e = emit[which]
            for t in range(CHAIN):
                f = unit((f @ move if begun or t else f) * e[:, t])
                forward[which, t] = f

        heads = at[:-1][n > 0]
        onward(heads, before[heads], begun=False)
        if (n > 1).any():
            inner = np.setdiff1d(np.arange(len(emit)), heads)
            does = np.broadcast_to(np.eye(k, dtype=np.float32), (len(inner), k, k))
            for t in range(CHAIN):
                grown = (does @ move) * emit[inner, t, None, :]
                does = np.where(real[inner, t, None, None], grown / grown.sum(axis=(1, 2), keepdims=True), does)
            of = np.zeros(len(emit), np.int64)
            of[inner] = np.arange(len(inner))
            for j in range(1, int(n.max())):
                here = at[:-1][n > j] + j
                out = forward[here - 1, -1] if j == 1 else np.einsum("ni,nij->nj", before[here - 1], does[of[here - 1]])
                before[here] = unit(out)
            for j in range(int(n.max()) - 1, 0, -1):
                here = at[:-1][n > j] + j
                after[here - 1] = unit(np.einsum("nij,nj->ni", does[of[here]], after[here]))
            onward(inner, before[inner], begun=True)
        r = after
        for t in range(CHAIN - 1, -1, -1):
            e = emit[:, t]
            back = unit((r * e) @ move.T)
            forward[:, t] *= r
            r = np.where(real[:, t, None], back, r)
        return unit(forward.reshape(-1, k)[place])


def fit(texts: list[tuple[str, str]], seed: int = SEED, epochs: int = EPOCHS) -> Crf:
    """A model from (text, language) pairs, by stochastic gradient steps on the chains' log-likelihood."""
    labels = sorted({lang for _, lang in texts})
    model, rng = Crf(labels), np.random.default_rng(seed)
    places, grams, by_label, at = [np.zeros((0, 2 * len(AFFIXES) + 1), np.int64)], [], {k: [] for k in range(len(labels))}, 0
    starts, lengths, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for text, lang in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        w = words(data, np.array([0, len(data)]))
        places.append(_affixes(data, w))
        grams.append(_trigrams(data))
        starts.append(w.start + reach)
        lengths.append(np.maximum(w.end - w.start - 2, 0))
        by_label[labels.index(lang)].append(np.arange(at, at + len(w.start)))
        at, reach = at + len(w.start), reach + len(data)
    places, starts, lengths = np.concatenate(places), np.concatenate(starts), np.concatenate(lengths)
    pools = {k: np.concatenate(v) for k, v in by_label.items() if v and sum(map(len, v)) > STEP}
    if not pools:
        return model
    grams, k = np.concatenate(grams), len(labels)
    square = {name: np.full_like(table, 1e-6) for name, table in (("affix", model.affix), ("trigram", model.trigram), ("transition", model.transition))}
    chains = max(1, sum(map(len, pools.values())) // STEP)
    keys = sorted(pools)
    for _ in range(epochs):
        for _ in range(0, chains, 256):
            seq, gold = np.empty((256, STEP), np.int64), np.empty((256, STEP), np.int64)
            for i in range(256):
                t = 0
                while t < STEP:
                    label = keys[rng.integers(len(keys))]
                    n = min(STEP - t, int(rng.integers(4, STEP + 1)))
                    a = int(rng.integers(0, len(pools[label]) - n + 1))
                    seq[i, t : t + n], gold[i, t : t + n] = pools[label][a : a + n], label
                    t += n
            flat = seq.ravel()
            # The trigrams of all words of the batch, one after the other, and which word each is of.
            n = lengths[flat]
            word = np.repeat(np.arange(len(flat)), n)
            tri = grams[np.repeat(starts[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            scores = model.affix[places[flat]].sum(axis=1) + np.stack([np.bincount(word, model.trigram[tri, j], len(flat)) for j in range(k)], axis=1)
            p, pairs = model.marginals(scores.reshape(256, STEP, k).astype(np.float32))
            error = (np.eye(k, dtype=np.float32)[gold] - p).reshape(-1, k)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            for name, index, grad in (("affix", places[flat].ravel(), np.repeat(error, places.shape[1], axis=0)), ("trigram", tri, error[word])):
                table, sq = getattr(model, name), square[name]
                at, back = np.unique(index, return_inverse=True)
                total = np.stack([np.bincount(back, grad[:, j], len(at)) for j in range(k)], axis=1)
                sq[at] += total**2
                table[at] += (0.2 * total / np.sqrt(sq[at])).astype(np.float32)
            square["transition"] += ((seen - pairs) / 256) ** 2
            model.transition += (0.05 * (seen - pairs) / 256 / np.sqrt(square["transition"])).astype(np.float32)
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = SEED) -> list[tuple[str, str]]:
    """About ``per_language`` labelled whole texts of each language (all, where there are no more): what the model is fitted on. No language's rows meet in a task."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    kept = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < F.least(F.lit(1.0), per_language / F.col("n")) * (1 << 40)
    rows = labelled.join(F.broadcast(counts), "lang").where(kept).select("doc_id", "text", "lang").collect()  # as many counts as languages
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] or 0, r["text"]))]


def label_words(model: Crf, data: np.ndarray, offsets: np.ndarray):
    """The words of a run of rows, and their posteriors of each language."""
    w = words(data, offsets)
    return w, model.posteriors(model.emissions(data, w), w.first)


LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Per document: doc_id, lang_pred and score (the mean posterior of that language over the words with letters)."""
    texts = sample(training)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts) if texts else None)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def label(batches):
        m = model.value
        for b in batches:
            for row, upto, data, offsets in slices(b.column(1), 1 << 19):
                ids = b.column(0).slice(row, upto - row)
                letters = b.column(2).slice(row, upto - row).to_numpy(zero_copy_only=False).astype(bool)
                if m is None:
                    yield batch(schema, ids, ["und"] * len(ids), [0.0] * len(ids))
                    continue
                w, p = label_words(m, data, offsets)
                sums = np.concatenate([[0], np.cumsum(LETTER_BYTES[data])])
                weight = (sums[w.end] > sums[w.start]).astype(float)
                total = np.stack([np.bincount(w.row, p[:, j] * weight, upto - row) for j in range(len(m.labels))], axis=1)
                best = total.argmax(axis=1)
                mean = total.max(axis=1) / np.maximum(np.bincount(w.row, weight, upto - row), 1)
                yield batch(schema, ids, [m.labels[i] if x else "und" for i, x in zip(best, letters, strict=True)], np.where(letters, np.clip(mean, 0, 1), 0.0))

    return own_columns(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(label, "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    out = identify(docs, own_columns(docs, "doc_id", "text", "lang").where(rest != 2))
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
