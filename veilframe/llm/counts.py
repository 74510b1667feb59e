"""Token counts under a unigram vocabulary, without making the tokens.

A text is read as the tokenizer reads it: a blank is a word mark, one mark stands before the text.
An Aho-Corasick automaton lists all pieces that end at each character; the best sum of scores and
the number of pieces on that path are carried along. Ties are those of the unigram tokenizer:
starts are tried in ascending order and only a better score replaces, so the longest piece wins.
A character that no single piece covers may also be unknown, at the least score of the vocabulary
less 10, and counts one token for each byte if the vocabulary has pieces for bytes.

No piece goes on behind a word mark or holds a line feed, so a text is cut there (as far as the
vocabulary bears it out) and the parts are counted once for all places where they recur. A projection of rows; long parts are one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from veilframe.llm.common import held, map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_PARTS = 400_000


class Vocabulary:
    """Pieces and scores of a model file; control and byte pieces match no text."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                  if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.whole = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        apart = "".join(c for c in "\t\n\r" if not any(c in p for p, _ in pieces))
        self.cut = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|[{apart}]" if apart else ""))

    def parts(self, text: str) -> list[str]:
        """Parts that are counted each for itself."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.whole else self.cut.findall(marked)

    def count(self, part: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(part)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)] if n < 4096 else []
        found = iter(self.automaton.iter(part))
        if ends:
            for end, match in found:
                ends[end].append(match)
        pending = None if ends else next(found, None)
        for end in range(n):
            if ends:
                matches = ends[end]
            else:
                matches = []
                while pending is not None and pending[0] == end:
                    matches.append(pending[1])
                    pending = next(found, None)
            top, count, first, single = None, 0, 0, False
            for length, score in matches:
                start = end + 1 - length
                value = best[start] + score
                single = single or length == 1
                if top is None or value > top or value == top and start < first:
                    top, count, first = value, pieces[start] + 1, start
            if not single:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, count = value, pieces[end] + (len(part[end].encode("utf-8", "surrogatepass")) if self.bytes else 1)
            best[end + 1], pieces[end + 1] = top, count
        return pieces[n], best[n]


class _Counter(dict):
    """part -> place of its count and score; keeps the parts met of late."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.counts, self.scores = np.zeros(1024, np.int64), np.zeros(1024)

    def __missing__(self, part: str) -> int:
        at = len(self)
        if at == len(self.counts):
            self.counts, self.scores = np.resize(self.counts, 2 * at), np.resize(self.scores, 2 * at)
        self.counts[at], self.scores[at] = self.vocabulary.count(part)
        self[part] = at
        return at

    def total(self, text: str) -> tuple[int, float]:
        parts = self.vocabulary.parts(text)
        at = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        return int(self.counts[at].sum()), float(self.scores[at].sum())


def token_counts(df: DataFrame, model: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys, `n_tokens` (long) and `score` (double) of the best segmentation of each text.

    `model` is the place of the vocabulary on every worker. Null and empty texts have no tokens and
    score 0; repeated rows count alike; other columns are ignored.
    """

    def make():
        counter = held("counts", model, lambda: _Counter(Vocabulary(model)))

        def work(texts: list) -> list[pa.Array]:
            made = [counter.total(t or "") for t in texts]
            if len(counter) > CACHE_PARTS:
                counter.clear()
            return [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())]

        return work

    return map_texts(df, keys, text, [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())], make)
