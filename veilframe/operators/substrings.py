"""Which of many needles stands anywhere inside which text, without pairing all of them.

An index by rare anchors. A needle is filed under one of its own byte n-grams: of up to 8 bytes it is
its own n-gram, of up to 15 it has n-grams of 8 bytes, of more n-grams of 16, and is filed under the one that
the texts have least often (counted in a table of fixed size; a needle with an n-gram that no text has is
nowhere). The tasks that read the texts get a bit table of the filed n-grams and pass on one row for each
n-gram of a text that may be among them, so that n-grams nobody looks for are never exchanged. These rows meet the
filed needles by equality, and only such candidates are looked for in the text. Both tables only
save work: what they let through in error does not stand the last test.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.lineage import cut_lineage

# Workers may not have this library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Needles of more bytes than the first have n-grams of the first's or the second's length; shorter ones are their own.
SHORT, LONG = 8, 16
#: Bytes of texts that are cut into n-grams at once.
PIECE = 1 << 20
#: Slots of the table of counts, in blocks of so many.
SLOT_BITS, SLOT_BLOCK = 20, 1 << 14
#: The bit table has 16 bits or more for a needle, up to 128 MB of them: with fewer, n-grams that it lets through in error outgrow the texts.
LEAST_BITS, MOST_BITS = 20, 30
#: Bits in one value of Spark's bitmap functions.
BITMAP = 1 << 15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each begins, with the end."""
    texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), places


def _grams(texts: pa.Array, scopes: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, number of the text, hash of scope and n-gram), piece by piece, for each place that has one."""
    data, places = _buffers(texts)
    for begin in range(int(places[0]), int(places[-1]), PIECE):
        end = min(begin + PIECE, int(places[-1]))
        size = end - begin
        padded = np.zeros(size + LONG, np.uint64)
        cut = data[begin:min(end + LONG, int(places[-1]))]
        padded[:len(cut)] = cut
        # Texts with a place in the piece, each so often as it has places.
        first = int(np.searchsorted(places, begin, "right")) - 1
        last = int(np.searchsorted(places, end, "left"))
        held = np.minimum(places[first + 1:last + 1], end) - np.maximum(places[first:last], begin)
        row = np.repeat(np.arange(first, last), held)
        left = places[row + 1] - np.arange(begin, end)
        known = {1: padded}
        for k in sorted(lengths):
            packed = _packed(known, k)[:size]
            at = np.flatnonzero(left >= k)
            rows = row[at]
            yield k, rows, _mixed(_mixed(packed[at]) ^ scopes[rows] + np.uint64(k))


def _packed(known: dict[int, np.ndarray], k: int) -> np.ndarray:
    """The n-grams of each place as numbers, from those of half the length."""
    if k not in known:
        a, b = _packed(known, k // 2), _packed(known, k - k // 2)
        ahead = np.zeros_like(b)
        ahead[:len(b) - k // 2] = b[k // 2:]
        known[k] = (a << np.uint64(8 * (k - k // 2)) | ahead) if k <= SHORT else _mixed(a) + ahead
    return known[k]


def _gram_length(size: Column) -> Column:
    """The length of the n-grams of a needle of so many bytes."""
    return F.when(size <= SHORT, size).when(size < LONG, SHORT).otherwise(LONG)


def _counts(bodies: DataFrame, lengths: Sequence[int]) -> np.ndarray:
    """How many n-grams of all texts fall into each slot."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, _, grams in _grams(batch.column("_text"), batch.column("_scope").to_numpy().view(np.uint64), lengths):
                found += np.bincount((grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        if found.any():
            blocks = found.reshape(-1, SLOT_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()),
                                              pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    form = "block int, counts binary"
    blocks = (bodies.select("_text", "_scope").mapInArrow(count, form)
              .groupBy("block").applyInArrow(add, form).collect())
    whole = np.zeros((1 << SLOT_BITS) // SLOT_BLOCK * SLOT_BLOCK, np.int64).reshape(-1, SLOT_BLOCK)
    for block, counts in blocks:
        whole[block] = np.frombuffer(counts, np.int64)
    return whole.reshape(-1)


def _filed(distinct: DataFrame, counts: np.ndarray | None) -> DataFrame:
    """Each needle with the n-gram under which it is filed; without those that are nowhere."""
    shared = distinct.sparkSession.sparkContext.broadcast(counts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("_k").to_numpy()
            for k in np.unique(length):
                part = batch.filter(pa.array(length == k))
                found = list(_grams(part.column("_needle"), part.column("_scope").to_numpy().view(np.uint64), [int(k)]))
                rows, grams = (np.concatenate([f[i] for f in found]) for i in (1, 2))
                often = np.ones(len(rows), np.int64)
                if shared.value is not None:
                    single = part.column("_size").to_numpy()[rows] == k
                    often = np.where(single, 1, shared.value[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
                nowhere = np.unique(rows[often == 0])
                order = np.lexsort((grams, often, rows))
                order = order[np.unique(rows[order], return_index=True)[1]]
                order = order[~np.isin(rows[order], nowhere)]
                chosen = part.take(pa.array(rows[order]))
                yield pa.RecordBatch.from_arrays(
                    [*chosen.select(kept).columns, pa.array(grams[order].view(np.int64))], [*kept, "_gram"])

    kept = [c for c in distinct.columns if c not in ("_k", "_size", "_scope")]
    return distinct.mapInArrow(choose, T.StructType([*distinct.select(*kept).schema.fields, T.StructField("_gram", T.LongType())]))


def _table_bits(needles: int) -> int:
    """The power of two of the bits for so many needles."""
    return min(max((16 * needles).bit_length(), LEAST_BITS), MOST_BITS)


def _bit_table(filed: DataFrame) -> tuple[int, np.ndarray]:
    """A table of 2 ** bits bits in which each filed n-gram has two, by the first and the last of its own bits."""
    bits = _table_bits(filed.count())
    places = F.array(F.shiftrightunsigned("_gram", 64 - bits), F.col("_gram").bitwiseAND(F.lit((1 << bits) - 1)))
    parts = (filed.select(F.explode(places).alias("_place"))
             .select(F.shiftright("_place", 15).alias("_part"), F.col("_place").bitwiseAND(F.lit(BITMAP - 1)).alias("_bit"))
             .repartition("_part")  # before they are joined: what a task before the exchange knows of a part is little
             .groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    table = np.zeros(((1 << bits) // BITMAP, BITMAP // 8), np.uint8)
    for part, held in parts.collect():
        table[part] = np.frombuffer(held, np.uint8)
    return bits, table.reshape(-1)


def _has(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of these bits of the table are set."""
    return table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0


def may_be_among(hashes: Column, filed: DataFrame) -> Column:
    """Whether a hash may be one of the table's column ``_gram``; the few that it lets through in error are for a join."""
    bits, table = _bit_table(filed)
    shared = filed.sparkSession.sparkContext.broadcast(table)

    def test(column: pa.Array) -> pa.Array:
        own = column.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(_has(shared.value, own >> np.uint64(64 - bits)) & _has(shared.value, own & np.uint64((1 << bits) - 1)))

    test.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(test, "boolean")(hashes)


def _met(bodies: DataFrame, names: Sequence[str], lengths: Sequence[int], bits: int, table: np.ndarray) -> DataFrame:
    """(names..., _gram) for the n-grams of each text that may have needles filed under them."""
    shared = bodies.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed, low = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            own = batch.select(list(names))
            for _, rows, grams in _grams(batch.column("_text"), batch.column("_scope").to_numpy().view(np.uint64), lengths):
                at = np.flatnonzero(_has(filed, grams >> np.uint64(64 - bits)))
                at = at[_has(filed, grams[at] & low)]
                rows, grams = rows[at], grams[at]
                order = np.lexsort((grams, rows))
                rows, grams = rows[order], grams[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
                if new.any():
                    yield pa.RecordBatch.from_arrays([*own.take(pa.array(rows[new])).columns,
                                                      pa.array(grams[new].view(np.int64))], [*names, "_gram"])

    form = T.StructType([*bodies.select(*names).schema.fields, T.StructField("_gram", T.LongType())])
    return bodies.select(*names, "_text", "_scope").mapInArrow(pick, form)


def substring_hits(texts: DataFrame, needles: DataFrame, key: Sequence[str],
                   scope: Sequence[str] = (), text: str = "text",
                   needle: str = "needle", unique: bool = False) -> DataFrame:
    """Distinct (key..., scope..., needle) such that the text contains the needle.

    ``key`` names a text; with ``scope`` a text is looked at only with the needles of
    its own scope. Empty needles are left out, null texts hold nothing. Texts and needles are
    read more than once, the needles at once: give written tables where they are costly. ``unique`` says that a
    needle stands once in its scope, which spares an exchange of them all; the result does not depend on it.
    """
    scope, key = list(scope), list(key)
    names = list(dict.fromkeys([*key, *scope]))
    of_scope = F.xxhash64(*scope) if scope else F.lit(0).cast("bigint")
    size = F.octet_length("_needle")
    listed = needles.filter(F.length(needle) > 0).select(*scope, F.col(needle).alias("_needle"))
    # At most nine lengths, each with and without needles that have more than one n-gram of it.
    kinds = listed.select(_gram_length(size).alias("_k"), (size > _gram_length(size)).alias("_choice")).distinct().collect()
    distinct = (listed if unique else listed.distinct()).select(
        "*", of_scope.alias("_scope"), size.alias("_size"), _gram_length(size).alias("_k"))
    bodies = texts.select(*names, F.col(text).alias("_text"), of_scope.alias("_scope"))
    lengths, choices = sorted({k for k, _ in kinds}), sorted({k for k, choice in kinds if choice})
    filed = cut_lineage(_filed(distinct, _counts(bodies, choices) if choices else None))
    grams = _met(bodies, names, lengths, *_bit_table(filed))
    # Names are one value, nulls in them included, so that what is joined by them stays where it is to be made distinct.
    name = F.struct(*names).alias("_name")
    candidates = grams.join(filed, [*scope, "_gram"]).select(name, "_needle")
    return (bodies.select(name, "_text").join(candidates, "_name").filter(F.contains("_text", "_needle"))
            .select("_name", "_needle").distinct().select("_name.*", F.col("_needle").alias(needle)))


def find_leaks(texts: DataFrame, tokens: DataFrame, key: Sequence[str],
               scope: Sequence[str], text: str = "text") -> DataFrame:
    """Every original of a text's scope that still stands in the text, with its token.

    ``tokens`` is a token table (scope..., placeholder, original, issued), in which an original stands once in its
    scope; it may lack the placeholder, the number or both, and then so do the leaks.
    """
    hits = substring_hits(texts, tokens.select(*scope, F.col("original")), key, scope,
                          text, "original", unique=True)
    known = [c for c in ("placeholder", "issued") if c in tokens.columns]
    return hits.join(tokens.select(*scope, "original", *known), [*scope, "original"]) if known else hits


def check_outgoing(texts: DataFrame, tokens: DataFrame, key: Sequence[str],
                   scope: Sequence[str], text: str = "text") -> DataFrame:
    """Each text with ``safe`` and the first leaked original, in the order in which tokens were issued."""
    leaks = find_leaks(texts, tokens, key, scope, text)
    first = leaks.groupBy(*key).agg(
        F.min(F.struct("issued", "placeholder", "original")).alias("_leak"),
        F.count("*").alias("n_leaks"))
    return (texts.join(first, list(key), "left")
            .withColumn("safe", F.col("_leak").isNull())
            .withColumn("leaked_token", F.col("_leak.original"))
            .withColumn("leaked_placeholder", F.col("_leak.placeholder"))
            .withColumn("n_leaks", F.coalesce("n_leaks", F.lit(0)))
            .drop("_leak"))
