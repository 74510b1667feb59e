"""Sets of word shingles as 64-bit hashes, for blocks of texts at once.

Words are maximal runs of bytes other than ASCII blanks, with A-Z in lower case. A text of at
least `k` words has its distinct `k`-word shingles; a shorter one the whole sequence as its only
shingle; one without words none.
"""

from __future__ import annotations

import numpy as np
import xxhash

from veilframe.llm.common import held

CACHE_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """The hash of each word met of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes() -> _Words:
    return held("shingles", "words", _Words)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    return h ^ (h >> np.uint64(29))


def _sequence(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that begin at each start."""
    h = np.full(len(starts), n, np.uint64)
    for i in range(n):
        h = mixed(h * _MIX + hashes[starts + i])
    return h


def shingle_sets(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending within each text, without repeats) and the place where each text's begin, plus the end."""
    lists = [words_of(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    known = word_hashes()
    hashes = np.fromiter((known[w] for x in lists for w in x), np.uint64, int(counts.sum()))
    return sets_of_hashes(hashes, counts, k)


def sets_of_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum(counts) - counts
    made = np.maximum(counts - (k - 1), 0)
    doc = np.repeat(np.arange(len(counts)), made)
    starts = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(begins, made)
    values = [_sequence(hashes, starts, k)]
    docs = [doc]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            values.append(_sequence(hashes, begins[short], n))
            docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    ends = np.searchsorted(doc, np.arange(len(counts) + 1)).tolist()
    for at, end in zip(ends[:-1], ends[1:]):
        value[at:end].sort()
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[first], doc[first]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))
