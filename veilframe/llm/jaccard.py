"""N-gram Jaccard join with prefix filters under several global token orders.

Two texts link when the Jaccard similarity of their shingle sets reaches `percent`. If the
sets are sorted by any global order of shingles, two linked sets of n shingles share one of
their first n - ceil(percent * n / 100) + 1. The orders here are pseudo-random permutations in
which the most frequent shingles of the corpus come last, so that passages that many texts
share do not gather these texts; any order is exact, frequency only saves work.

1. Count the shingles of all texts, in blocks of a task; those met once in a block only if near the front of the first order.
   The `FREQUENT` most frequent ones (a bounded list) close every order.
2. Equal sets become one class, with its prefix under each order. Prefixes under the first order are posted,
   each posting with the set's size and what of the set is left from its place on: two linked sets
   meet at a shingle from which on both have as many left as they must have in common.
3. Every posting list pairs its members with a few of them, so that groups of near copies join at
   linear cost (three leads of a list, told by hashes; further rounds may follow for lists that still hold several components).
4. Lists that still hold several components give the pairs across components, of sizes that allow a link.
   Where that makes many more pairs than its members have shingles in their prefixes, a list is split by
   the shingles of the second order, and these lists by those of the third, where that makes fewer pairs: pairs that would share no prefix
   under these orders are not made. Nor are those whose signs (parities of hashed shingles) differ in more bits than linked sets can.
5. Of each pair, prefixes under all orders meet first: they must have shingles in common under each, and enough
   for the rest of the sets to make up what is missing. Only for pairs that pass, sets meet.

All links between different components are thus tested; components are exact. Sets are compared
as 64-bit hashes; classes are named by a 64-bit hash of their set. Postings are shuffled in
packed form, by a hash of the shingle's key, those of frequent shingles by key and class; a task
holds one bucket of them at a time. Pairs of one class are compared in parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.llm.common import discard, map_texts, most_frequent, slices, trimmed, written
from veilframe.llm.graph import components
from veilframe.llm.shingles import mixed, shingle_sets

#: Frequent shingles that close each order: a bounded list, sent to every task.
FREQUENT = 1 << 16
#: Fewer texts than this do not make a shingle frequent.
OFTEN = 16
#: The count covers this multiple of the prefix, and beyond it what is met twice in a block: all that may move up when frequent shingles leave it.
AHEAD = 1.5
#: But at least so many shingles of each text, so that all of short texts are counted even if met once.
COUNTED = 64
#: Postings that a task holds before it passes them on, and the parts that keys are dealt to.
BLOCK = 1_000_000
BUCKETS = 4096
#: Fixed odd factors; each gives another order.
ORDERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD)
#: The members, told by hashes of these numbers, that lists are paired with in each round, before pairs across components are made.
ROUNDS = ((0, 1, 2),)
#: A list is split by the next order if it would make this many times more pairs than rows by splitting.
SPLIT = 4
#: Bits of the map of texts that are compared: a fixed size, sent to every task; if it fills, more texts are joined.
SIEVE_BITS = 1 << 23
SIEVE_ROW = 1 << 11
#: Classes that a task remembers, so that near-by copies post their prefix once.
KNOWN = 200_000
#: Pairs of one class that a task compares at a time; the set of that class is sent once for each such part.
PARTNERS = 256
#: Longs of the sign of a set: bit i is whether an odd number of its shingles have the hash i. Two sets differ in at least as many shingles as their signs in bits.
SIGN = [f"sign{i}" for i in range(8)]
_LAST = np.uint64(1 << 63)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def first_key(values: np.ndarray) -> np.ndarray:
    """The place of a shingle in the first order, before frequent ones are put last; also its identity."""
    return mixed(values * np.uint64(ORDERS[0])) >> np.uint64(1)


class Order:
    """The orders, given the keys of frequent shingles, rarest first."""

    def __init__(self, frequent: np.ndarray) -> None:
        self.rank = np.argsort(frequent, kind="stable")
        self.sorted = frequent[self.rank]

    def keys(self, values: np.ndarray, factor: int) -> np.ndarray:
        identity = first_key(values)
        key = identity if factor == ORDERS[0] else mixed(values * np.uint64(factor)) >> np.uint64(1)
        if len(self.sorted) and len(values):
            at = np.minimum(np.searchsorted(self.sorted, identity), len(self.sorted) - 1)
            found = self.sorted[at] == identity
            key = key.copy()
            rank = self.rank[at[found]].astype(np.uint64)
            # frequent ones of like counts change places from order to order too
            key[found] = _LAST + (rank if factor == ORDERS[0] else rank ^ np.uint64(factor >> 7 & 63))
        return key

    def prefixes(self, values: np.ndarray, ends: np.ndarray, lengths: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
        """The first keys of each set under one order, ascending, and where each set's begin."""
        key = self.keys(values, factor)
        at = np.concatenate(([0], np.cumsum(lengths)))
        made = np.empty(at[-1], np.uint64)
        for i in np.flatnonzero(lengths).tolist():
            own, n = key[ends[i]:ends[i + 1]], int(lengths[i])
            made[at[i]:at[i + 1]] = np.sort(np.partition(own, n - 1)[:n] if n < len(own) else own)
        return made, at


def _dealt(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings in packed form, a row for each bucket.

    The bucket is of the whole key, and of key and node where the key is frequent, so that its list is dealt out too.
    """
    mark = mixed(keys)
    hot = keys >= _LAST
    mark[hot] = mixed(mark[hot] ^ mixed(nodes[hot].view(np.uint64)))
    bucket = (mark % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts, len(keys))
    blobs = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
    columns = {"bucket": pa.array(bucket[cuts], pa.int64()), "keys": blobs(keys), "nodes": blobs(nodes[order])}
    if sizes is not None:
        columns["sizes"] = blobs(sizes[order])
    return pa.RecordBatch.from_pydict(columns)


def _whole_buckets(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """The packed columns of a partition sorted by bucket, as arrays of whole buckets; a few small buckets come together."""
    held: list[list[np.ndarray]] = [[] for _ in names]
    last, size = None, 0
    for batch in batches:
        for bucket, *blobs in zip(*(batch.column(c).to_pylist() for c in ("bucket", *names))):
            if bucket != last and size > BLOCK:
                yield [np.concatenate(x) for x in held]
                held, size = [[] for _ in names], 0
            for x, blob in zip(held, blobs):
                x.append(np.frombuffer(blob, np.uint64))
            last, size = bucket, size + len(held[0][-1])
    if size:
        yield [np.concatenate(x) for x in held]


def frequent_keys(docs: DataFrame, text: str, k: int, percent: int) -> np.ndarray:
    """At most FREQUENT keys of shingles that stand in many texts, rarest first."""

    def counted(held: list[np.ndarray], fronts: list[np.ndarray]) -> pa.RecordBatch:
        # a key goes out once for a block, with its count; frequent keys have no place yet, and none reaches _LAST
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        sent = n > 1
        sent[keys.searchsorted(np.concatenate(fronts))] = True
        return _dealt(keys[sent], n[sent].astype(np.uint64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, held, fronts, size = Order(np.zeros(0, np.uint64)), [], [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                values, ends = shingle_sets(part.column("t").to_pylist(), k)
                n = np.diff(ends)
                lengths = np.minimum(n, np.maximum(np.ceil(prefix_length(n, percent) * AHEAD).astype(np.int64), COUNTED))
                held.append(first_key(values))
                fronts.append(order.prefixes(values, ends, lengths, ORDERS[0])[0])
                size += len(values)
                if size > BLOCK:
                    yield counted(held, fronts)
                    held, fronts, size = [], [], 0
        if held:
            yield counted(held, fronts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _whole_buckets(batches, "keys", "nodes"):
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["key", "n"])

    packed = docs.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(trimmed("jaccard", deal), "bucket long, keys binary, nodes binary")
    counts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed("jaccard", count), "key long, n long")
    top = most_frequent(written(counts, "counts"), FREQUENT).toPandas().sort_values(["n", "key"])
    return top["key"].to_numpy(np.int64).view(np.uint64)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _names(values: np.ndarray, ends: np.ndarray) -> list[int | None]:
    """A 64-bit name for each set; none for an empty one."""
    raw = memoryview(values.astype("<u8")).cast("B")
    names = [xxhash.xxh3_64_intdigest(raw[8 * a:8 * b]) if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return [None if x is None else x - (1 << 64) if x >> 63 else x for x in names]


def signs(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sign of each set, a row of longs each."""
    bits, n = 64 * len(SIGN), len(ends) - 1
    place = mixed(values ^ np.uint64(ORDERS[1])) % np.uint64(bits) + np.repeat(np.arange(n, dtype=np.uint64), np.diff(ends)) * np.uint64(bits)
    odd = (np.bincount(place.astype(np.int64), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def posted(docs: DataFrame, frequent: np.ndarray, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(key, n, node, prefix, front, sign) of each row; prefix and front are left out where the task has posted the same set before.

    The prefix is that under the first order; the front is n and the prefixes under all orders, in 32 bits each.
    """
    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("front", T.BinaryType())]
    fields += [T.StructField(s, T.LongType()) for s in SIGN]

    def make():
        order, known = Order(frequent), set()

        def work(texts: list) -> list[pa.Array]:
            values, ends = shingle_sets(texts, k)
            n = np.diff(ends)
            nodes = _names(values, ends)
            fresh = np.zeros(len(texts), bool)
            for i, node in enumerate(nodes):
                if node is not None and node not in known:
                    fresh[i] = True
                    known.add(node)
            if len(known) > KNOWN:
                known.clear()
            lengths = np.where(fresh, prefix_length(n, percent), 0)
            made = [order.prefixes(values, ends, lengths, f) for f in ORDERS]
            short = [x.astype(np.uint32) for x, _ in made]
            at = made[0][1].tolist()
            fronts = [np.concatenate([np.array([size], np.uint32), *(np.sort(x[a:b]) for x in short)]).tobytes() if new else None
                      for size, new, a, b in zip(n.tolist(), fresh.tolist(), at[:-1], at[1:])]
            marks = signs(values, ends)
            return [pa.array(n), pa.array(nodes, pa.int64()), _lists(*made[0]), pa.array(fronts, pa.binary()), *(pa.array(marks[:, i], mask=~fresh) for i in range(len(SIGN)))]

        return work

    return map_texts(docs, (key,), text, fields, make)


def posting_lists(rows: DataFrame) -> DataFrame:
    """(token, node, n, rest) for each member of each list of several classes, and of each list of a frequent shingle.

    n is the size of the set; rest is how many of its shingles do not stand before the token in the order.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, nodes, sizes = batch.column("prefix"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            for at in range(0, len(lists), 2048):
                part = lists.slice(at, 2048)
                lengths = np.diff(part.offsets.to_numpy())
                n = np.repeat(sizes[at:at + 2048], lengths).astype(np.uint64)
                place = np.arange(len(n)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield _dealt(part.flatten().to_numpy().view(np.uint64), np.repeat(nodes[at:at + 2048], lengths), n << np.uint64(32) | (n - place.astype(np.uint64)))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sizes in _whole_buckets(batches, "keys", "nodes", "sizes"):
            nodes = nodes.view(np.int64)
            order = np.lexsort((nodes, keys))
            keys, nodes, sizes = keys[order], nodes[order], sizes[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            kept = new.copy()
            kept[1:] |= nodes[1:] != nodes[:-1]  # a class posts once for each task that met it
            keys, nodes, sizes, new = keys[kept], nodes[kept], sizes[kept], new[kept]
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            several = (size[group] > 1) | (keys >= _LAST)
            for at in range(0, int(several.sum()), 100_000):
                cut = np.flatnonzero(several)[at:at + 100_000]
                n, rest = (sizes[cut] >> np.uint64(32)).astype(np.int64), (sizes[cut] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut].view(np.int64)), pa.array(nodes[cut]), pa.array(n), pa.array(rest)], names=["token", "node", "n", "rest"])

    packed = rows.where(F.size("prefix") > 0).select("node", "n", "prefix").mapInArrow(trimmed("jaccard", deal), "bucket long, keys binary, nodes binary, sizes binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed("jaccard", lists), "token long, node long, n long, rest long")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes allow two sets that meet at a shingle to link, if it is the first they have in common.

    They have at most in common what both have left from there; linked sets must have percent / (100 + percent) of both sizes.
    """
    n = [F.col(f"{x}n") for x in (a, b)]
    return (F.least(*n) * 100 >= percent * F.greatest(*n)) & (F.least(f"{a}rest", f"{b}rest") * (100 + percent) >= percent * (n[0] + n[1]))


def star_pairs(named: DataFrame, turns: tuple[int, ...], percent: int) -> DataFrame:
    """(a, b): each member b of a list (token, node, n, rest, root) with the leads a of the list, of which there is one for each turn."""
    lead = [F.min(F.struct(_turned("node", t).alias("by"), "node", "root", "n", "rest")).alias(f"lead_{t}") for t in turns]
    leads = named.groupBy("token").agg(*lead)
    met = named.join(leads, "token").withColumn("l", F.explode(F.array(*(f"lead_{t}" for t in turns))))
    return met.where((F.col("root") != F.col("l.root")) & may_link("", "l.", percent)).select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()


def _reach(percent: int) -> Column:
    """`percent` times the size of the greatest set that a member of a list may link with, if they meet there first."""
    return F.col("rest") * (100 + percent) - percent * F.col("n")


def _early(percent: int) -> Column:
    """Whether a member may link with a set as large as its own. Of two members that may link, the lesser is early."""
    return _reach(percent) >= percent * F.col("n")


def _hopeful(lists: DataFrame, percent: int) -> DataFrame:
    """The lists without members that reach no early one."""
    least = lists.groupBy("key").agg(F.min(F.when(_early(percent), F.col("n"))).alias("least"))
    return lists.join(least, "key").where(_reach(percent) >= percent * F.col("least")).drop("least")


def _costs(lists: DataFrame, percent: int, *more: str) -> DataFrame:
    """(key, pairs, tokens) of lists of several roots: pairs across roots with an early member, and shingles in the prefixes of all members."""
    late = F.when(_early(percent), 0).otherwise(1)
    members = lists.groupBy("key", "root", *more).agg(F.count("*").alias("m"), F.sum(late).alias("late"), F.sum(F.col("n") * (100 - percent) / 100 + 1).alias("tokens"))
    across = [(F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))) / 2 for c in ("m", "late")]
    sums = members.groupBy("key", *more).agg(F.count("*").alias("roots"), (across[0] - across[1]).alias("pairs"), F.sum("tokens").alias("tokens"))
    return sums.where("roots > 1 AND pairs > 0").drop("roots")


def pairs_across(named: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of lists (token, node, n, rest, root) across roots, of sizes, places and signs that allow a link.

    Lists are told apart by ranges of size as well: the lesser set of a link is in the range of the
    greater or the one below. A list that would make more than SPLIT times as many pairs as its members' prefixes have
    shingles is split by these, under the second order, then under the third, unless its parts would make as many pairs together.
    """
    step = math.log(100 / percent) * (1 + 1e-9)
    band = F.floor(F.log("n") / step) if percent < 100 else F.col("n")
    lists = named.withColumn("band", band).withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    lists = lists.select(F.xxhash64("token", "at").alias("key"), (F.col("at") == F.col("band")).alias("home"), "node", "root", "n", "rest")
    lists = written(_hopeful(lists, percent), "hopeful")
    marks = rows.where("front IS NOT NULL").select("node", *SIGN).dropDuplicates(["node"])
    made = []
    for order in range(1, len(ORDERS)):
        costs = written(_costs(lists, percent).withColumn("split", F.col("pairs") > SPLIT * F.col("tokens")), "costs")
        made.append(_met(lists.join(costs.where("NOT split"), "key", "left_semi"), marks, percent))
        if costs.where("split").isEmpty():
            break
        wide = lists.join(costs.where("split"), "key", "left_semi")
        parts = written(_hopeful(_split(wide, rows, order), percent), "split")
        fewer = _costs(parts, percent, "whole").groupBy("whole").agg(F.sum("pairs").alias("then"))
        kept = costs.where("split").join(fewer, costs["key"] == fewer["whole"], "left").where("then >= pairs").select("key")
        kept = written(kept, "kept")
        made.append(_met(wide.join(kept, "key", "left_semi"), marks, percent))
        lists = parts.join(kept.select(F.col("key").alias("whole")), "whole", "left_anti").drop("whole")
    else:
        made.append(_met(lists, marks, percent))
    pairs = made[0]
    for more in made[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _met(lists: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs across roots of each list; the greater set must be in the size range of the list."""
    signed = lists.join(marks, "node")
    one, other = (signed.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("home", "node", "root", "n", "rest", *SIGN))) for x in "ab")
    greater = F.struct("b_n", "b_node") < F.struct("a_n", "a_node")
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SIGN[1:]), F.bit_count(F.col(f"a_{SIGN[0]}").bitwiseXOR(F.col(f"b_{SIGN[0]}"))))
    near = differ * (100 + percent) <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    met = one.where("a_home").join(other, (one["key"] == other["key"]) & greater & (F.col("a_root") != F.col("b_root")) & may_link("a_", "b_", percent) & near)
    swap = _turned("b_node", 0) < _turned("a_node", 0)
    return met.select(F.when(swap, F.col("b_node")).otherwise(F.col("a_node")).alias("a"), F.when(swap, F.col("a_node")).otherwise(F.col("b_node")).alias("b"))


def _split(lists: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """The lists, split by the shingles that their members have in their prefixes under another order; `whole` is the list a part comes from."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tokens = [_front(x)[1][order] for x in part.column("front").to_pylist()]
                again = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
                dealt = part.drop_columns(["front", "key"]).take(again)
                whole = part.column("key").take(again)
                keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)[again.to_numpy()]
                keys = mixed(keys ^ mixed(np.concatenate(tokens).astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *dealt.columns, whole], names=["key", *dealt.schema.names, "whole"])

    fronts = fronts_of(lists.select("node").distinct(), rows)
    met = lists.join(fronts, "node").select("key", "home", "node", "root", "n", "rest", "front")
    return met.mapInArrow(trimmed("jaccard", split), lists.select("key", "home", "node", "root", "n", "rest", F.col("key").alias("whole")).schema)


def _turned(node: str, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _nodes_with_partners(pairs: DataFrame) -> DataFrame:
    """(node, ats): the (a, part) of each pair that a class is in, also if it is the a; a part has about PARTNERS pairs of an a."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("b", F.struct("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")).alias("at"))
    both = dealt.select(F.col("b").alias("node"), "at").unionByName(dealt.select(F.col("at.a").alias("node"), "at"))
    return both.distinct().groupBy("node").agg(F.collect_list("at").alias("ats"))


def sieve(keys: DataFrame) -> DataFrame:
    """(at, bits): a bitmap of SIEVE_BITS, in rows of SIEVE_ROW bytes, in which the bit of each key's hash is set.

    Tasks make bitmaps of their keys, and these are joined row by row; the size is fixed.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE_BITS >> 3, np.uint8)
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        used = [i for i in range(len(bits) // SIEVE_ROW) if bits[i * SIEVE_ROW:(i + 1) * SIEVE_ROW].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([bits[i * SIEVE_ROW:(i + 1) * SIEVE_ROW].tobytes() for i in used], pa.binary())], names=["at", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column("at").to_pylist(), batch.column("bits").to_pylist()):
                held[at] = held[at] | np.frombuffer(raw, np.uint8) if at in held else np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "bits"])

    marked = keys.select(_bit(F.col(keys.columns[0])).alias("bit")).mapInArrow(trimmed("jaccard", mark), "at long, bits binary")
    return written(marked.repartition("at").mapInArrow(trimmed("jaccard", join), "at long, bits binary"), "sieve")


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))


def sifted(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be one of those that a sieve was made of, and those whose key is none.

    The bitmap is broadcast: at most SIEVE_BITS, whatever the data.
    """
    own = F.broadcast(bitmap.select(F.col("at").alias("__at"), F.col("bits").alias("__bits")))
    bit = _bit(F.col(f"`{key}`"))
    met = df.join(own, F.floor(bit / (8 * SIEVE_ROW)) == F.col("__at"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) % SIEVE_ROW + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    return met.where(is_set).select(*df.columns), met.where(~is_set).select(*df.columns)


def _front(raw: bytes) -> tuple[int, list[np.ndarray]]:
    """The size of a set, and its prefix under each order, sorted."""
    whole = np.frombuffer(raw, np.uint32)
    return int(whole[0]), np.split(whole[1:], len(ORDERS))


def _fronts_fit(a: tuple[int, list[np.ndarray]], b: tuple[int, list[np.ndarray]], percent: int) -> bool:
    """Whether two fronts allow the similarity.

    Of two prefixes, the one that ends first in the order holds all common shingles up to there; so
    the sets have in common at most what the prefixes have, and what lies beyond one of them. Keys in 32 bits
    can only have more in common than the shingles, so what is rejected is no link.
    """
    (m, left), (n, right) = a, b
    if min(m, n) * 100 < percent * max(m, n):
        return False
    beyond = max(m - len(left[0]), n - len(right[0]))
    for x, y in zip(left, right):
        at = np.minimum(x.searchsorted(y), len(x) - 1)
        common = int(np.count_nonzero(x[at] == y))
        if not common or (common + beyond) * (100 + percent) < percent * (m + n):
            return False
    return True


def _sets_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(a.searchsorted(b), len(a) - 1)
    return int(np.count_nonzero(a[at] == b)) * (100 + percent) >= percent * (len(a) + len(b))


def _compared(dealt: DataFrame, column: str, read: Callable, test: Callable, percent: int) -> DataFrame:
    """The pairs (a, b) that pass a test of what `read` makes of their column; they come sorted by a, that of a itself first."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = left = None
        for batch in batches:
            found = []
            for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set"))):
                if a == b:
                    current, left = a, read(raw)
                elif current != a:
                    raise ValueError("a class whose set is not there")
                elif test(left, read(raw), percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    each = dealt.select(F.explode("ats").alias("at"), F.col("node").alias("b"), F.col(column).alias("set")).select("at.*", "b", "set")
    sorted_ = each.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b") != F.col("a"), "b")
    return sorted_.mapInArrow(trimmed("jaccard", compare), "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those that share prefixes under all orders and reach the similarity.

    Fronts go to each pair they are in first, then, for pairs that these leave, sets; those of an a
    once for each part of its pairs.
    """
    fronts = fronts_of(_nodes_with_partners(pairs), rows)
    near = written(_compared(fronts, "front", _front, _fronts_fit, percent), "near")
    sets = sets_of(_nodes_with_partners(near), classes, docs, key, text, k)
    both = _compared(sets, "full", lambda raw: np.frombuffer(raw, np.uint64), _sets_link, percent)
    links = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    discard(near, sets)
    return links


def fronts_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of `nodes`, and the front of each; a class has one for each task that met it."""
    return rows.where("front IS NOT NULL").select("node", "front").join(nodes, "node").dropDuplicates(["node"])


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The columns of `nodes`, and the sets of these classes as sorted hashes (`full`).

    One text of each class is cut into shingles again; a bitmap keeps other texts out of the join.
    """
    wanted = written(nodes.join(classes.select("node", "doc"), "node"), "wanted")
    texts = docs.select(F.col(f"`{key}`").alias("its"), F.col(f"`{text}`").alias("t"))
    bitmap = sieve(wanted.select("doc"))
    texts = sifted(texts, "its", bitmap)[0].join(wanted, F.col("its").eqNullSafe(F.col("doc")))

    def make():
        def work(texts: list) -> list[pa.Array]:
            values, ends = shingle_sets(texts, k)
            cut = zip(ends[:-1].tolist(), ends[1:].tolist())
            return [pa.array(_names(values, ends), pa.int64()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())]

        return work

    fields = [T.StructField("made", T.LongType()), T.StructField("full", T.BinaryType())]
    made = map_texts(texts, tuple(nodes.columns), "t", fields, make).where("made = node").drop("made")
    sets = written(made.dropDuplicates(["node"]), "sets")
    discard(wanted, bitmap)
    return sets


def _several(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists (token, node, n, rest) whose members are in several components, with the root of each member."""
    named = lists.join(roots, "node", "left").select("token", "node", "n", "rest", F.coalesce("root", "node").alias("root"))
    tokens = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return named.join(tokens, "token", "left_semi")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the size of its set, the least key it reaches by links.

    Null texts and texts without words have no shingles and link with nothing: their component is
    their own key. Rows with equal sets are in one component, also repeated rows. Null keys take
    part; a component's id is null only if all its keys are. Other columns are ignored, and an
    empty table gives no rows. What any run has beside its postings: FREQUENT keys on the driver
    and in each task.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    frequent = frequent_keys(docs, text, k, percent)
    rows = written(posted(docs, frequent, key, text, k, percent), "posted").withColumnRenamed(key, "doc")
    classes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.min("n").alias("n")), "classes")
    lists = written(posting_lists(rows), "lists")
    args = (rows, classes, docs, key, text, k, percent)
    links = roots = None
    for turns in ROUNDS:
        named = lists.withColumn("root", F.col("node")) if roots is None else written(_several(lists, roots), "named")
        stars = written(star_pairs(named, turns, percent), "stars")
        more = verified(stars, *args)
        discard(stars)
        links = more if links is None else links.unionByName(more)
        if roots is not None:
            discard(named)
            if more.isEmpty():
                break
            discard(roots)
        roots = written(components(links), "roots")
    named = written(_several(lists, roots), "named")
    discard(lists)
    across = written(pairs_across(named, rows, percent), "across")
    final = roots
    if not across.isEmpty():
        more = verified(across, *args)
        if not more.isEmpty():
            final = written(components(links.unionByName(more)), "roots")
    final = final.join(classes.select("node", "doc"), "node").select("node", "root", "doc")
    least = final.groupBy("root").agg(F.min("doc").alias("component_id"))
    ids = final.select("node", "root").join(least, "root").select("node", "component_id")
    known = written(classes.select("node", "doc").join(ids, "node", "left").select("node", F.coalesce("component_id", "doc").alias("component_id")), "known")
    # rows without shingles get a key of their own, so that they do not meet in one task
    lone = F.xxhash64("doc", F.lit("no shingles"))
    return (rows.select("doc", "n", F.coalesce("node", lone).alias("node"))
            .join(known, "node", "left")
            .select(F.col("doc").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows without those whose component has a lesser key, and without repeated rows.

    A key names a document: rows of one key stay or go together; null is a key too. Texts are not shuffled, but for
    those that a bitmap of the keys that go, or are repeated, lets through. Columns may have any names.
    """
    names = docs.columns
    coded = [f"column_{i}" for i in range(len(names))]
    docs, key, text = docs.toDF(*coded), coded[names.index(key)], coded[names.index(text)]
    rows = written(components_of(docs, key, text, k, percent), "components")
    going = rows.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("going")).distinct()
    repeated = rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1").select(F.col(key).alias("going"))
    going, repeated = written(going, "going"), written(repeated, "repeated")
    own = F.col(f"`{key}`")
    maybe, clear = sifted(docs, key, sieve(going.unionByName(repeated)))
    apart = maybe.join(going, own.eqNullSafe(F.col("going")), "left_anti")
    twice = apart.join(repeated, own.eqNullSafe(F.col("going")), "left_semi")
    once = apart.join(repeated, own.eqNullSafe(F.col("going")), "left_anti")
    mark = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    single = twice.withColumn("__mark", mark).dropDuplicates([key, "__mark"]).drop("__mark")
    return clear.unionByName(once).unionByName(single).toDF(*names)
