"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into overlapping passages and weighted by TF-IDF, with document counts
of all documents. A randomised SVD, of which the products run over the passages where they are
and only sums of a bounded shape (hashed words x RANK) come to the driver, gives a latent space;
the passages in it are the index. Windows of every document are folded in the same way, and
windows near a passage (cosine) are candidates. A candidate is a leak if the longest common
subsequence of words covers nearly all of the item, or covers most of it and the item's answer
as well. Documents are not shuffled: the index goes to them, in blocks of a bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veilframe.llm.common import map_texts, slices, written
from veilframe.llm.shingles import mixed, word_hashes, words_of

#: Words are hashed to so many columns, for document counts and for the latent space.
COLUMNS = 1 << 18
#: Dimensions of the latent space, and of the random range that it is found in.
RANK, RANGE = 128, 160
#: Items of at least so many words are cut into passages, and documents into windows, of the length and step given.
SCALES = ((12, 16, 8), (6, 8, 4), (1, 4, 2))
#: A candidate window has this share of its squared weight in words that the benchmark has, and this cosine to a passage.
MASS, COSINE = 0.3, 0.7
#: The share of an item's words that a leak has in order; from the lower one on, the answer must be there too.
SURE, LIKELY = 0.9, 0.6
#: Passages that one block of the index holds.
BLOCK_PASSAGES = 32_768


def hashed(text: str | None) -> np.ndarray:
    words, known = words_of(text), word_hashes()
    return np.fromiter((known[w] for w in words), np.uint64, len(words))


def columns_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COLUMNS - 1)).astype(np.int64)


def _totals(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of packed vectors (at, vector) by place; at most COLUMNS places."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column("at").to_pylist(), batch.column("vector").to_pylist()):
                vector = np.frombuffer(raw, np.float64)
                sums[at] = sums[at] + vector if at in sums else vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "vector"])

    summed = parts.repartition("at").mapInArrow(add, "at long, vector binary")
    return {r["at"]: np.frombuffer(r["vector"], np.float64) for r in summed.toLocalIterator()}


def document_weights(docs: DataFrame, text: str) -> np.ndarray:
    """The inverse document frequency of each hashed word, over all documents."""
    block = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(COLUMNS), 0
        for batch in batches:
            for part in slices(batch, "t"):
                lists = [columns_of(hashed(t)) for t in part.column("t").to_pylist()]
                key = np.concatenate([c + i * COLUMNS for i, c in enumerate(lists)] or [np.zeros(0, np.int64)])
                key.sort()
                held += np.bincount(key[np.append(True, key[1:] != key[:-1])] % COLUMNS if len(key) else key, minlength=COLUMNS)
                n += part.num_rows
        at = [i for i in range(0, COLUMNS, block) if held[i:i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([np.full(1, float(n)).tobytes(), *(held[i:i + block].tobytes() for i in at)], pa.binary())], names=["at", "vector"])

    found = _totals(docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(count, "at long, vector binary"), block)
    n = float(found.pop(-1, np.zeros(1))[0])
    df = np.zeros(COLUMNS)
    for at, vector in found.items():
        df[at:at + block] = vector
    return np.log((n + 1) / (df + 1)) + 1e-3


def scale_of(n: int) -> int:
    return next(i for i, (least, _, _) in enumerate(SCALES) if n >= least)


def window_starts(n: int, length: int, step: int) -> np.ndarray:
    return np.arange(0, max(1, n - length + step), step)


def passages_of(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, scale, at, words) for each passage: packed hashes; one row at least for each item with words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, t in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist()):
                words = hashed(t)
                if len(words):
                    scale = scale_of(len(words))
                    _, length, step = SCALES[scale]
                    rows += [(key, scale, int(a), words[a:a + length].astype("<u8").tobytes()) for a in window_starts(len(words), length, step)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("item").type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
                                             names=["item", "scale", "at", "words"])

    picked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("scale", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("words", T.BinaryType())])
    return picked.mapInArrow(cut, schema)


def _random_rows(columns: np.ndarray) -> np.ndarray:
    """The rows of a fixed random sign matrix (COLUMNS x RANGE)."""
    place = columns.astype(np.uint64)[:, None] * np.uint64(RANGE) + np.arange(RANGE, dtype=np.uint64)
    return np.where(mixed(mixed(place + np.uint64(1))) >> np.uint64(63), 1.0, -1.0)


def _weighted(raw: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and normalised TF-IDF weights of a passage."""
    columns, n = np.unique(columns_of(np.frombuffer(raw, np.uint64)), return_counts=True)
    w = n * weights[columns]
    return columns, w / np.linalg.norm(w)


def latent_space(passages: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that the passages have, and their rows of the leading right singular vectors."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for raw in batch.column("words").to_pylist():
                columns, w = _weighted(raw, weights)
                y = w @ _random_rows(columns)
                for c, x in zip(columns.tolist(), w):
                    sums[c] = sums[c] + x * y if c in sums else x * y
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "vector"])

    ranged = _totals(passages.select("words").mapInArrow(products, "at long, vector binary"), RANGE)
    columns = np.array(sorted(ranged), np.int64)
    if not len(columns):
        return columns, np.zeros((0, 1), np.float32)
    basis, _ = np.linalg.qr(np.stack([ranged[c] for c in columns.tolist()]))
    packed = basis.astype(np.float32)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((packed.shape[1], packed.shape[1]))
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                at, w = _weighted(raw, weights)
                z = w @ packed[np.searchsorted(columns, at)]
                total += np.outer(z, z)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "vector"])

    square = _totals(passages.select("words").mapInArrow(gram, "at long, vector binary"), 0)[0].reshape(basis.shape[1], basis.shape[1])
    values, vectors = np.linalg.eigh(square)
    kept = np.argsort(values)[::-1][:RANK]
    kept = kept[values[kept] > 1e-9 * max(values.max(), 1e-300)]
    return columns, (basis @ vectors[:, kept]).astype(np.float32)


@dataclass
class Index:
    """The latent space, and blocks of passages and of the items that they are cut from."""

    weights: np.ndarray
    columns: np.ndarray
    vectors: np.ndarray
    blocks: list[dict]
    item_type: T.DataType


def last_sentence(text: str) -> str:
    """What stands for the answer of an item that has none of its own."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def build(items: DataFrame, docs: DataFrame, item: str = "item_id", text: str = "text", answer: str | None = None, doc_text: str = "text") -> Index:
    """An index of all items with words; weights from all documents. `answer` names a column of answers."""
    weights = document_weights(docs, doc_text)
    passages = written(passages_of(items, item, text), "passages")
    columns, vectors = latent_space(passages, weights)
    blocks: list[dict] = []
    picked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("t"), (F.col(f"`{answer}`").cast("string") if answer else F.lit(None).cast("string")).alias("a"))
    for row in picked.toLocalIterator():  # streamed: a block at a time is held to be sent
        words = hashed(row["t"])
        if not len(words):
            continue
        if not blocks or sum(len(p) for p in blocks[-1]["passages"].values()) >= BLOCK_PASSAGES:
            blocks.append({"items": [], "passages": {}})
        scale = scale_of(len(words))
        _, length, step = SCALES[scale]
        block, made = blocks[-1], []
        for a in window_starts(len(words), length, step):
            at, w = _weighted(words[a:a + length].tobytes(), weights)
            z = w @ vectors[np.searchsorted(columns, at)]
            made.append((z / max(np.linalg.norm(z), 1e-12)).astype(np.float32))
        block["passages"].setdefault(scale, []).extend((z, len(block["items"])) for z in made)
        block["items"].append((row["item"], words, hashed(row["a"] if row["a"] is not None else last_sentence(row["t"]))))
    return Index(weights, columns, vectors, blocks, items.schema[item].dataType)


class Pattern:
    """A sequence of words, for common subsequences by bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.size = len(words)
        self.full = (1 << self.size) - 1
        self.places: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, words: Iterable[int]) -> int:
        """The length of the longest common subsequence."""
        v = self.full
        for w in words:
            place = self.places.get(w)
            if place:
                u = v & place
                v = (v + u | v - u) & self.full
        return self.size - v.bit_count()


class _Searcher:
    """Of one task: a block of the index, ready to be searched."""

    def __init__(self, index: Index, block: dict) -> None:
        self.weights = index.weights
        self.column = np.full(COLUMNS, -1, np.int32)
        self.column[index.columns] = np.arange(len(index.columns))
        self.vectors = np.concatenate((index.vectors, np.zeros((1, index.vectors.shape[1]), np.float32)))
        self.items = block["items"]
        self.patterns = [(Pattern(words), Pattern(answer)) for _, words, answer in self.items]
        self.scales = {s: (np.stack([z for z, _ in rows]), np.array([i for _, i in rows])) for s, rows in block["passages"].items()}

    def candidates(self, words: np.ndarray, ends: np.ndarray, scale: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, word after the last, item, cosine) of windows near a passage."""
        _, length, step = SCALES[scale]
        n = np.diff(ends)
        made = np.where(n > 0, np.maximum(1, -(-(n - length + step) // step)), 0)
        doc = np.repeat(np.arange(len(n)), made)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)) * step + ends[:-1][doc]
        stop = np.minimum(start + length, ends[1:][doc])
        columns = columns_of(words)
        w = self.weights[columns]
        place = self.column[columns]
        mass = np.concatenate(([0.0], np.cumsum(w * w)))
        own = np.concatenate(([0.0], np.cumsum(np.where(place >= 0, w * w, 0))))
        near = np.flatnonzero((own[stop] - own[start]) >= MASS * (mass[stop] - mass[start]))
        index, item = self.scales[scale]
        for at in range(0, len(near), 2048):
            rows = near[at:at + 2048]
            grid = start[rows][:, None] + np.arange(length)
            valid = grid < stop[rows][:, None]
            grid = np.minimum(grid, len(words) - 1)
            z = np.einsum("ij,ijk->ik", np.where(valid, w[grid], 0).astype(np.float32), self.vectors[np.where(valid, place[grid], -1)])
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            cosine = z @ index.T
            for i, j in zip(*np.nonzero(cosine >= COSINE)):
                d = doc[rows[i]]
                yield int(d), int(start[rows[i]] - ends[d]), int(stop[rows[i]] - ends[d]), int(item[j]), float(cosine[i, j])

    def search(self, texts: list) -> list[list[dict]]:
        lists = [hashed(t) for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        words = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        found: list[dict[int, dict]] = [{} for _ in texts]
        if not len(words):
            return [[] for _ in texts]
        tested: set[tuple[int, int, int]] = set()
        for scale in self.scales:
            for doc, start, stop, item, cosine in self.candidates(words, ends, scale):
                known = found[doc].get(item)
                if known is not None or (doc, start, item) in tested:
                    if known is not None:
                        known["cosine"] = max(known["cosine"], cosine)
                    continue
                tested.add((doc, start, item))
                whole, answer = self.patterns[item]
                first = max(0, start - whole.size)
                region = lists[doc][first:stop + whole.size].tolist()
                share = whole.common(region) / whole.size
                if share >= SURE or share >= LIKELY and (not answer.size or answer.common(region) / answer.size >= LIKELY):
                    found[doc][item] = {"item": self.items[item][0], "common": share, "cosine": cosine, "first_word": start, "end_word": stop}
        return [list(x.values()) for x in found]


def leaks(docs: DataFrame, index: Index, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and one row for each item that a text holds: item, common, cosine, first_word, end_word.

    `common` is the share of the item's words in the longest common subsequence; the place is the
    window first found. Null and empty texts hold nothing, and items without words are held by
    nothing; repeated rows are found alike; other columns are ignored. Without items or
    documents there are no rows.
    """
    kind = T.StructType([T.StructField("item", index.item_type), T.StructField("common", T.DoubleType()), T.StructField("cosine", T.DoubleType()),
                         T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    made = [_searched(docs, index, b, keys, text, kind) for b in index.blocks] or [_searched(docs.limit(0), index, {"items": [], "passages": {}}, keys, text, kind)]
    found = made[0]
    for more in made[1:]:
        found = found.unionByName(more)
    return found.select(*keys, F.explode("held").alias("held")).select(*keys, "held.*")


def _searched(docs: DataFrame, index: Index, block: dict, keys: tuple[str, ...], text: str, kind: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.list_(to_arrow_type(kind))
    space = replace(index, blocks=[])  # a task gets the latent space and its own block, not the others

    def make():
        searcher = _Searcher(space, block)
        return lambda texts: [pa.array(searcher.search(texts), arrow)]

    return map_texts(docs, keys, text, [T.StructField("held", T.ArrayType(kind))], make)


def clean(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names.

    Null and empty texts hold nothing and stay, repeated rows stay or go together, and without items all stay; an
    empty table stays empty.
    """
    names = docs.columns
    coded = [f"column_{i}" for i in range(len(names))]
    docs, text = docs.toDF(*coded), coded[names.index(text)]
    kind = T.StructType([T.StructField("item", index.item_type), T.StructField("common", T.DoubleType()), T.StructField("cosine", T.DoubleType()),
                         T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    for block in index.blocks:
        docs = _searched(docs, index, block, tuple(coded), text, kind).where(F.size("held") == 0).select(*coded)
    return docs.toDF(*names)
