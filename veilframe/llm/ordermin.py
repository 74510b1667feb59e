"""Order MinHash fingerprints: near in them means near in edit distance.

The items of a text are its k-mers of code points, each with the number of its occurrences before
it, so that repeats count. For each of SIZE hash functions the TUPLE items of least hash are
selected, put back in the order in which they stand in the text, and hashed together: two texts
agree in a component when they share the selected items and their order, so a moved block costs
likeness although the set of k-mers stays. A fingerprint is SIZE components of 32 bits in hex.

A text shorter than k is one item; an empty or null text has none, and texts with fewer items
than TUPLE select all they have. Equal texts have equal fingerprints whatever their length: a long
text is hashed in blocks of positions, all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.llm.common import map_texts, slices, written

K = 5
SIZE = 64
TUPLE = 2
#: Positions whose hashes under all functions are held at once.
BLOCK = 4096
#: Items of a function that are looked at on average; where a function meets too few, all are.
NEAR_LEAST = 24

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_LOW = 20
_FACTORS = np.random.Generator(np.random.PCG64(20)).integers(1, 2**31, SIZE, np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FOLD
    h = (h ^ (h >> np.uint64(29))) * _PRIME
    return h ^ (h >> np.uint64(32))


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each position on; of all of them if there are fewer."""
    width = min(k, len(codes))
    h, have, factor = codes.astype(np.uint64), 1, _PRIME
    while have * 2 <= width:  # hashes of doubled width, from two that stand side by side
        h = h[:-have] * factor + h[have:]
        have, factor = have * 2, np.uint64(int(factor) ** 2 % 2**64)
    rest = codes.astype(np.uint64)
    while have < width:
        h = h[:-1] * _PRIME + rest[have:have + len(h) - 1]
        have += 1
    return _mixed(h + np.uint64(width))


def items(text: str, k: int = K) -> np.ndarray:
    """A hash of each k-mer with its occurrence number, in text order; k-mers are told apart by 44 bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64)
    grams = _grams(codes, k) >> np.uint64(_LOW)
    n = len(grams)
    if n < 1 << _LOW:  # position in the low bits: a plain sort keeps equal k-mers in text order
        packed = np.sort((grams << np.uint64(_LOW)) | np.arange(n, dtype=np.uint64))
        order, ordered = (packed & np.uint64((1 << _LOW) - 1)).astype(np.int64), packed >> np.uint64(_LOW)
    else:
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    places = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = places - np.maximum.accumulate(np.where(first, places, 0))
    return _mixed(grams * _PRIME + occurrence)


def _values(hashes: np.ndarray, short: np.ndarray, function: np.ndarray) -> np.ndarray:
    """What items are ranked by under a function: its 32-bit product, then the rest of the item's hash."""
    return ((short * _FACTORS[function]).astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(2**32 - 1))


def _selected(hashes: np.ndarray, take: int) -> np.ndarray:
    """The positions of the items of least value under each function, in text order: SIZE rows of `take`."""
    n = len(hashes)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    functions = np.arange(SIZE)
    if n <= 2 * NEAR_LEAST:
        ranked = _values(hashes[None, :], short[None, :], functions[:, None])
        return np.sort(np.argsort(ranked, axis=1, kind="stable")[:, :take], axis=1)
    limit = np.uint32(NEAR_LEAST * 2**32 // n)
    function, place = [], []
    product, below = np.empty((SIZE, BLOCK), np.uint32), np.zeros((SIZE, BLOCK), bool)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        np.multiply(short[None, at:at + size], _FACTORS[:, None], out=product[:, :size])
        np.less(product[:, :size], limit, out=below[:, :size])
        below[:, size:] = False
        words = np.flatnonzero(below.view(np.uint64))  # few: eight flags are looked at together
        word, inside = np.nonzero(below.reshape(-1, 8)[words])
        flat = words[word] * 8 + inside
        function.append(flat // BLOCK)
        place.append(flat % BLOCK + at)
    function, place = np.concatenate(function), np.concatenate(place)
    order = np.argsort(function, kind="stable")
    function, place = function[order], place[order]
    counts = np.bincount(function, minlength=SIZE)
    column = np.arange(len(function)) - np.repeat(np.cumsum(counts) - counts, counts)
    table = np.full((SIZE, max(int(counts.max()), take)), np.uint64(2**64 - 1))
    where = np.zeros(table.shape, np.int64)
    table[function, column], where[function, column] = _values(hashes[place], short[place], function), place
    chosen = np.take_along_axis(where, np.argpartition(table, take - 1, axis=1)[:, :take], axis=1)
    for j in np.flatnonzero(counts < take):
        chosen[j] = np.argsort(_values(hashes, short, functions[j]), kind="stable")[:take]
    return np.sort(chosen, axis=1)


def signature(text: str | None, k: int = K) -> np.ndarray:
    """The components of a text, unsigned 32-bit integers."""
    hashes = items(text or "", k)
    take = min(TUPLE, len(hashes))
    made = np.full(SIZE, np.uint64(take))
    if take:
        for column in hashes[_selected(hashes, take)].T:
            made = _mixed(made * _PRIME + column)
    return (made >> np.uint64(32)).astype(">u4")


def fingerprints(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", k: int = K) -> DataFrame:
    """The key columns, `n_chars` and `fingerprint` of each text.

    Null and empty texts have 0 characters and the fingerprint of no items; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """

    def make():
        def work(texts: list) -> list[pa.Array]:
            return [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([signature(t, k).tobytes().hex() for t in texts])]

        return work

    return map_texts(df, keys, text, [T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())], make)


def likeness(a: Column, b: Column) -> Column:
    """The share of components that two fingerprints have in common, 0 to 1."""
    part = lambda c, i: F.substring(c, i * 8 + 1, F.lit(8))
    same = F.filter(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: part(a, i) == part(b, i))
    return F.size(same) / F.lit(float(SIZE))


def edited(text: str, follower: str) -> str:
    """A text with the last quarter of its code points replaced by the first as many of its follower."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + follower[:quarter]


class _Met:
    """A text and what is known of it."""

    def __init__(self, key, text: str | None, k: int) -> None:
        self.key, self.text, self.signature = key, text or "", signature(text, k)


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_RESULT_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
#: Digests are bytes until the end: half as long in the tables between.
_RESULT_DDL = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(own: np.ndarray, text: str, follower: str, of_follower: np.ndarray, k: int) -> tuple:
    changed = edited(text, follower)
    other = signature(changed, k) if changed != text else own
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), own.tobytes(), other.tobytes(),
            float(np.mean(own == other)), float(np.mean(own == of_follower)))


def edit_likeness(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text's fingerprint beside those of its edited form (see `edited`) and of the text that follows it.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A text
    is followed by that of the next key, ascending, nulls first; rows of equal key stand in the
    order of their texts' hashes; the last text is followed by the first, a lone one by itself.
    Texts are sorted by key over all partitions, which takes one shuffle of them; each task
    compares neighbours as they come and holds two at a time. The first and the last text of each
    partition are set aside and meet in a join of one row for each partition. An empty table
    gives no rows; other columns are not read.
    """
    kind = df.schema[key].dataType
    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    order = [F.col("key"), F.xxhash64("text"), F.col("text").isNull()]
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    schema = T.StructType([T.StructField("key", kind)]).add("kind", "integer").add("part", "integer").add("body", "string")
    for field in T._parse_datatype_string(_RESULT_DDL).fields:
        schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, arrow = TaskContext.get().partitionId(), None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = (arrow, pa.int32(), pa.int32(), pa.string(), *_RESULT_TYPES)
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            arrow = batch.column("key").type
            for block in slices(batch, "text"):
                rows = []
                for name, body in zip(block.column("key").to_pylist(), block.column("text").to_pylist()):
                    now = _Met(name, body, k)
                    if before is None:
                        rows.append((name, 1, part, now.text, len(now.text), None, now.signature.tobytes(), None, None, None))
                    else:
                        rows.append((before.key, 0, part, None, *_compared(before.signature, before.text, now.text, now.signature, k)))
                    before = now
                yield packed(rows)
        if before is not None:
            yield packed([(before.key, 2, part, before.text, len(before.text), None, before.signature.tobytes(), None, None, None)])

    table = written(ordered.mapInArrow(run, schema), "neighbours")
    shown = lambda n: F.lower(F.hex(n)).alias(n) if n.endswith(("sha256", "fingerprint")) else F.col(n)
    names = [F.col("key").alias(key), *map(shown, RESULT)]
    # One number for each partition that has rows.
    parts = sorted(r["part"] for r in table.where("kind = 1").select("part").collect())
    if not parts:
        return table.select(*names)
    follows = table.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = table.where("kind = 1").select(F.col("part").alias("next"), F.col("body").alias("next_body"), F.col("fingerprint").alias("next_fingerprint"))
    open_rows = table.where("kind = 2").select("key", "part", "body", "fingerprint").join(follows, "part").join(heads, "next")
    closed = T.StructType([T.StructField("key", kind)])
    for field in T._parse_datatype_string(_RESULT_DDL).fields:
        closed.add(field)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = lambda b: np.frombuffer(b, ">u4")
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("body", "fingerprint", "next_body", "next_fingerprint")}
                made = _compared(components(row["fingerprint"]), row["body"], row["next_body"], components(row["next_fingerprint"]), k)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), *(pa.array([v], t) for v, t in zip(made, _RESULT_TYPES))], names=closed.names)

    finished = open_rows.select("key", "body", "fingerprint", "next_body", "next_fingerprint").mapInArrow(close, closed)
    return table.where("kind = 0").select("key", *RESULT).unionByName(finished).select(*names)
