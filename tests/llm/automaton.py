"""The language model as one automaton in one process, for few words: what the tables and their traversal are tested against."""

from __future__ import annotations

import math

import numpy as np

from paperloom.llm.lm_score import DISCOUNT, END, VOCABULARY, _ids


class Automaton:
    """States and arcs of corpora of at most VOCABULARY words.

    State 0 is the empty context, state i the vocabulary's i-th word, higher ones are kept bigrams.
    """

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, total: int, distinct: int, grams: dict[int, int], discount: float = DISCOUNT):
        base, self.vocabulary = VOCABULARY + 2, vocabulary
        self.floor = math.log10(total + distinct + 1)
        self.unigram = np.concatenate([[0.0], np.log10(counts + 1.0) - self.floor])
        self.known = np.concatenate([[False], counts > 0])
        self.width = len(vocabulary) + 1
        end = int(_ids(np.array([END], np.uint64), vocabulary)[0])
        bigrams = {g: c for g, c in grams.items() if g < base * base and g // base != end}
        self.fail, self.backoff = [0] * self.width, [0.0] * self.width
        state_of: dict[int, int] = {}
        for g in sorted({g // base for g in grams if g >= base * base} & bigrams.keys()):
            if g % base != end:
                state_of[g] = len(self.fail)
                self.fail.append(g % base)
                self.backoff.append(0.0)
        #: state * width + id -> (next state, log10 probability)
        self.arcs: dict[int, tuple[int, float]] = {}
        count = np.concatenate([[0], counts])
        lower: dict[int, float] = {}
        for context, arcs in _by_context(bigrams, base).items():
            p = {w: (c - discount) / count[context] for w, c in arcs.items()}
            self._weigh(context, p, {w: 10 ** self.unigram[w] for w in p})
            for w, x in p.items():
                lower[context * base + w] = x
                self.arcs[context * self.width + w] = (state_of.get(context * base + w, w), math.log10(x))
        for context, arcs in _by_context({g: c for g, c in grams.items() if g >= base * base}, base).items():
            if (state := state_of.get(context)) is None:
                continue
            p = {w: (c - discount) / bigrams[context] for w, c in arcs.items()}
            suffix = context % base
            self._weigh(state, p, {w: lower.get(suffix * base + w) or 10 ** (self.backoff[suffix] + self.unigram[w]) for w in p})
            for w, x in p.items():
                self.arcs[state * self.width + w] = (state_of.get(suffix * base + w, w), math.log10(x))

    def _weigh(self, state: int, p: dict[int, float], below: dict[int, float]) -> None:
        """The backoff weight with which all probabilities after ``state`` sum to one; arcs that leave nothing for others are scaled."""
        rest = 1 - sum(p.values())
        if rest < 1e-9:
            for w in p:
                p[w] *= (1 - 1e-6) / (1 - rest)
            rest = 1e-6
        self.backoff[state] = math.log10(rest / max(1 - sum(below.values()), 1e-12))

    def traverse(self, ids: list[int]) -> float:
        """The log10 probability of a text's tokens, but for the unigram part of words outside the vocabulary."""
        arcs, fail, backoff, unigram, width = self.arcs, self.fail, self.backoff, self.unigram_list, self.width
        state, total = 0, 0.0
        for i in ids:
            while state:
                if i and (arc := arcs.get(state * width + i)) is not None:
                    break
                total += backoff[state]
                state = fail[state]
            else:
                total += unigram[i]
                state = i
                continue
            state = arc[0]
            total += arc[1]
        return total

    def __setstate__(self, state):
        self.__dict__ = state
        self.unigram_list = self.unigram.tolist()


def _by_context(grams: dict[int, int], base: int) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = {}
    for g, c in grams.items():
        out.setdefault(g // base, {})[g % base] = c
    return out
