"""Many keywords looked for in one pass over each text.

The keywords make a trie over their bytes; failure links, worked into one table of
next states, turn it into an automaton that tells after each byte which keywords
end there. An Arrow batch is read as one run of bytes, cut into lanes of ``LANE``
bytes that all take their steps at once; a lane reads on for as long as a keyword
that began in it can. Texts end in a line break, which no keyword has, so none is
found across texts. What a text has is a set of bits, and how many of some words
it has, a count of bits: no text is scanned again for another list.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.functions import rules as R
from paperloom.functions.text import safe_lower

LANE = 256


class Matcher:
    """An automaton of lower-case words without line breaks."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(set(words))
        if any(not w or "\n" in w for w in self.words):
            raise ValueError("keywords are neither empty nor of several lines")
        self.bits = {w: i for i, w in enumerate(self.words)}
        self.longest = max((len(w.encode()) for w in self.words), default=1)
        used = sorted({b for w in self.words for b in w.encode()})
        self.kind = np.zeros(256, np.int32)  # 0: bytes that no keyword has
        self.kind[used] = np.arange(1, len(used) + 1)
        self.kinds = len(used) + 1
        children, ends = [{}], [0]
        for w in self.words:
            at = 0
            for b in w.encode():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(0)
                at = children[at][b]
            ends[at] |= 1 << self.bits[w]
        table = np.zeros((len(children), self.kinds), np.int32)
        level = [(0, 0)]  # states with their failure links, shallow ones first
        for at, link in level:
            ends[at] |= ends[link]
            table[at] = table[link] if at else 0
            for b, child in children[at].items():
                level.append((child, int(table[link, self.kind[b]]) if at else 0))
                table[at, self.kind[b]] = child
        self.next = (table * self.kinds).ravel()  # states are held as where their rows begin
        self.width = len(self.words) // 64 + 1
        self.found = np.array([[e >> 64 * k & (1 << 64) - 1 for k in range(self.width)] for e in ends], np.uint64)
        self.ending = self.found.any(axis=1)

    def masks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The keywords of each text as bits: one row a text, whose last byte is a line break. data[offsets[i]:offsets[i + 1]] is text i."""
        out = np.zeros((len(offsets) - 1, self.width), np.uint64)
        lanes = -(-len(data) // LANE)
        grid = np.zeros(lanes * LANE, np.int32)
        grid[: len(data)] = self.kind[data]
        grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
        state, at, states = np.zeros(lanes, np.int32), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ending = np.repeat(self.ending, self.kinds)
        for t in range(LANE + self.longest - 1):
            # Beyond its end a lane reads what the next ones begin with.
            more, row = divmod(t, LANE)
            state = self.next[state[: max(lanes - more, 0)] + grid[row, more:]]
            hit = np.flatnonzero(ending[state])
            if len(hit):
                at.append(hit * LANE + t)
                states.append(state[hit] // self.kinds)
        text = np.searchsorted(offsets, np.concatenate(at), "right") - 1
        met = np.unique(text * len(self.ending) + np.concatenate(states))
        text, state = np.divmod(met, len(self.ending))
        if len(text):
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[first]] = np.bitwise_or.reduceat(self.found[state], first, axis=0)
        return out


MATCHER = Matcher([w for must, may in R.DOCUMENT_TYPES.values() for w in (*must, *may)] + [w for words in R.DOMAINS.values() for w in words] + [*R.HIGH_RISK, *R.MEDIUM_RISK])
_PARTS = [f"k{i}" for i in range(MATCHER.width)]


@F.arrow_udf(StructType([StructField(p, LongType()) for p in _PARTS]))
def _marks(texts: pa.Array) -> pa.Array:
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    masks = MATCHER.masks(data, offsets - offsets[0])
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in masks.T], _PARTS)


def marks(text: Column) -> Column:
    """The keywords that a text has in any case, as bits; null has none."""
    return _marks(F.concat(safe_lower(text), F.lit("\n")))


def hits(found: Column, words: Iterable[str]) -> Column:
    """How many of the words are among the found keywords."""
    wanted = sum(1 << MATCHER.bits[w] for w in set(words))
    parts = [(p, wanted >> 64 * i & (1 << 64) - 1) for i, p in enumerate(_PARTS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    counts = [F.bit_count(found[p].bitwiseAND(F.lit(signed(x)).cast("long"))) for p, x in parts if x]
    return sum(counts[1:], counts[0]) if counts else F.lit(0)
