"""Language identification of words, spans and texts.

Words are runs of letters. The script of a word narrows the languages it can be in to those that
were seen in that script. Each word has a score for each language, from its count in texts of
the language or, for words outside the vocabulary, from its letter trigrams. A Viterbi pass over
the scores with a penalty for each switch labels spans; the language of a text is the one
that covers most letters.

Fitting counts words and trigrams over all labelled texts: blocks of texts are counted in the
tasks, sums are shuffled, and only the `VOCABULARY` most frequent words and `TRIGRAMS` trigrams
(a bounded model) come to the driver. Prediction is a projection of rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veilframe.llm.common import map_texts, most_frequent, only_for, slices, written

VOCABULARY = 40_000
TRIGRAMS = 40_000
#: Log-likelihoods are smoothed by this count, and a word counts for this much at most.
SMOOTHING = 0.5
WORD_LIMIT = 4.0
#: What a change of language costs, in the same unit.
SWITCH = 10.0
CACHE_WORDS = 300_000
COUNT_WORDS = 250_000
#: A script belongs to a language if it has this share of the language's letters.
SCRIPT_SHARE = 0.01

WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile("[²³¹¼-¾]|[^\x00-ɏ]")
# First code points of blocks and the script of each, in ascending order.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "other"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Burmese"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"),
    (0x20000, "Han"), (0x32000, "other"),
)
_BLOCKS = [first for first, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_BLOCKS, ord(word[0])) - 1][1]


def words_of(text: str) -> list[str]:
    words = WORD.findall(text)
    return [w for w in words if any(map(str.isalpha, w))] if ODD.search(text) else words


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, token, n) from (lang, t): words, trigrams, and letters by script."""
    only_for("langid")
    counts: dict[str, Counter] = defaultdict(Counter)

    def flushed() -> pa.RecordBatch:
        parts = []
        for lang, words in counts.items():
            low, scripts, tri = Counter(), Counter(), Counter()
            for word, n in words.items():
                low[word.lower()] += n
                scripts[script_of(word)] += n * len(word)
            for word, n in low.items():
                for t in _trigrams(word):
                    tri[t] += n
            parts += [(kind, lang, list(held), list(held.values())) for kind, held in (("w", low), ("s", scripts), ("t", tri))]
        counts.clear()
        sizes = [len(tokens) for _, _, tokens, _ in parts]
        named = lambda at: pa.array([p[at] for p in parts], pa.string()).take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32()))
        tokens = pa.array([t for p in parts for t in p[2]], pa.string())
        return pa.RecordBatch.from_arrays([named(0), named(1), tokens, pa.array([n for p in parts for n in p[3]], pa.int64())], names=["kind", "lang", "token", "n"])

    for batch in batches:
        for part in slices(batch, "t"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("t").to_pylist()):
                counts[lang].update(words_of(text))
            if sum(map(len, counts.values())) > COUNT_WORDS:
                yield flushed()
    yield flushed()


@dataclass
class Model:
    """Languages, and log-likelihoods of the bounded word and trigram lists for each (a row for each token).

    The last row for trigrams is that of all others.
    """

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trigrams: dict[str, int] = field(default_factory=dict)
    trigram_scores: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    scripts: dict[str, np.ndarray] = field(default_factory=dict)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a text and a language; without such rows it knows no language."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    counts = rows.mapInArrow(_counted, "kind string, lang string, token string, n long").groupBy("kind", "lang", "token").agg(F.sum("n").alias("n"))
    counts = written(counts.groupBy("kind", "token").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")), "counts")
    totals: dict[str, Counter] = defaultdict(Counter)
    for r in counts.select("kind", F.explode("by").alias("lang", "n")).groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r["kind"]][r["lang"]] = r["n"]
    langs = sorted(totals["s"])
    if not langs:
        return Model([])

    def listed(kind: str, size: int) -> tuple[dict[str, int], np.ndarray]:
        total = np.array([math.log(totals[kind][x] + SMOOTHING * size) for x in langs])
        top = most_frequent(counts.where(F.col("kind") == kind), size).collect()
        rows = [[r["by"].get(x, 0) for x in langs] for r in top] + [[0] * len(langs)]
        return {r["token"]: i for i, r in enumerate(top)}, np.log(np.array(rows) + SMOOTHING) - total

    letters = counts.where("kind = 's'").collect()  # one row for each script
    scripts = {r["token"]: np.array([r["by"].get(x, 0) >= SCRIPT_SHARE * totals["s"][x] for x in langs]) for r in letters}
    return Model(langs, *listed("w", VOCABULARY), *listed("t", TRIGRAMS), {s: x for s, x in scripts.items() if x.any()})


class _Scorer:
    """The scores of words; keeps those met of late as rows of a matrix."""

    def __init__(self, model: Model) -> None:
        self.model, self.places, self.matrix, self.known = model, {}, np.zeros((0, len(model.langs))), np.zeros(0)

    def learn(self, lists: list[list[str]]) -> None:
        """Make rows for the new words of a block of texts."""
        if len(self.places) > CACHE_WORDS:
            self.places, self.matrix, self.known = {}, self.matrix[:0], self.known[:0]
        new = [w for w in set().union(*lists) if w not in self.places]
        if not new:
            return
        model = self.model
        other = len(model.trigrams)
        scores, known = np.empty((len(new), len(model.langs))), np.ones(len(new))
        flat: list[int] = []
        starts, rare = [], []
        for i, word in enumerate(new):
            low = word.lower()
            at = model.words.get(low)
            if at is None:
                rare.append(i)
                starts.append(len(flat))
                padded = f"^{low}$"
                flat += [model.trigrams.get(padded[j:j + 3], other) for j in range(len(padded) - 2)]
            else:
                scores[i] = model.word_scores[at]
        if rare:
            scores[rare] = np.add.reduceat(model.trigram_scores[flat], starts)
            seen = np.add.reduceat((np.array(flat) < other).astype(float), starts)
            known[rare] = seen / np.diff([*starts, len(flat)])
        every = np.ones(len(model.langs), bool)
        allowed = np.stack([model.scripts.get(script_of(w), every) for w in new])
        scores = np.where(allowed, scores, -np.inf)
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.known = np.concatenate((self.known, np.where(allowed.any(1), known, 0.0)))
        self.matrix = np.concatenate((self.matrix, np.maximum(scores - scores.max(1, keepdims=True), -WORD_LIMIT)))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each row on the best path; of equal paths one that stays, then the least label."""
    n, size = scores.shape
    if size == 1:
        return np.zeros(n, np.int64)
    # If no stretch of words speaks for another language by more than half a switch, no path beats staying.
    total = scores.sum(0)
    best = int(total.argmax())
    over = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, size)), over[:-1])), axis=0)
    if (over - low).max() <= switch / 2:
        return np.full(n, best)
    value, came = [0.0] * size, []
    for row in scores.tolist():
        top = max(value)
        source, floor = value.index(top), top - switch
        came.append((source, [v >= floor for v in value]))
        value = [(v if v >= floor else floor) + s for v, s in zip(value, row)]
    label = value.index(max(value))
    path = np.empty(n, np.int64)
    for at in range(n - 1, -1, -1):
        path[at] = label
        source, stays = came[at]
        if not stays[label]:
            label = source
    return path


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def _label(text: str | None, words: list[str], scorer: _Scorer) -> tuple[str, float, list[dict], float]:
    langs = scorer.model.langs
    if not words or not langs:
        return "und", 0.0, [], 0.0
    places = np.fromiter(map(scorer.places.__getitem__, words), np.int64, len(words))
    scores = scorer.matrix[places]
    path = viterbi(scores)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    known = float((scorer.known[places] * letters).sum() / letters.sum())
    cover = np.bincount(path, letters, len(langs))
    top = int(cover.argmax())
    total = scores[path == top].sum(0)
    sure = 1 / np.exp(np.maximum(total - total[top], -50)).sum()
    changes = np.flatnonzero(path[1:] != path[:-1]) + 1
    if not len(changes):  # no word runs on at its ends, so the first and last words are where their letters are first and last
        return langs[top], float(sure), [{"start": text.index(words[0]), "end": text.rindex(words[-1]) + len(words[-1]), "lang": langs[top]}], known
    places = [m.span() for m in WORD.finditer(text) if any(map(str.isalpha, m.group()))]
    cuts = [0, *changes.tolist(), len(words)]
    spans = [{"start": places[a][0], "end": places[b - 1][1], "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:])]
    return langs[top], float(cover[top] / cover.sum() * sure), spans, known


def identify(df: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys, `lang_pred`, `score` (0 to 1), `lang_spans` (start, end, lang; code points) and `known` of each text.

    The score is the share of letters in spans of the language, times how sure these spans are: it compares the
    model's languages with one another. `known` (0 to 1) does not: it is the share of letters in words that the model has
    met, where an unmet word counts by the share of its trigrams that it has met; a text in none of the languages has little of it.
    Null texts, texts without letters and a model without languages give `und`, score 0 and no
    spans. Nothing but the text goes into a prediction; other columns are ignored.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.ArrayType(SPAN)), T.StructField("known", T.DoubleType())]

    def make():
        scorer = _Scorer(model)

        def work(texts: list) -> list[pa.Array]:
            lists = [words_of(t) if t else [] for t in texts]
            if model.langs:
                scorer.learn(lists)
            made = [_label(t, words, scorer) for t, words in zip(texts, lists)]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.list_(_ARROW_SPAN)), pa.array([m[3] for m in made], pa.float64())]

        return work

    return map_texts(df, keys, text, fields, make)
