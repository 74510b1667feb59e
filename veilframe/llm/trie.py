"""Prefix trie of conversations that are rebuilt from a base conversation's head and their own suffix.

The fingerprint of a sequence of turns is an element of a monoid: under concatenation,
(length m, hash a) and (length n, hash b) make (m + n, a * B**n + b), modulo a prime. Every
conversation's running products are made once, over the turns as they are stored; a rebuilt
conversation is a head of its base and a suffix of its own, so the fingerprints of all its
prefixes follow from these products, and no rebuilt text is ever made. What belongs to a node of
the trie shares depth and fingerprint. Members are equal when their last turns are: each carries a
reference to its last turn, its content's SHA-256, which must be the same in the whole node, and
shorter prefixes are checked in the nodes above. Should two sequences ever share a fingerprint,
the check sees it and all is done again with other bases.

Turns are sorted over all partitions, so one conversation may lie in many tasks: each makes the
products of its part, and what is carried over a border (one element for each partition) is put
in front. Sums over subtrees need no walk: a conversation owns the nodes of which it is the least
member, these are the end of its path, and each node is owned once; so the nodes below a node are
its members' owned ones, and every figure is a sum over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.common import written

PRIME = 2**61 - 1
#: Characters of a list of ids that are one row on the way to a digest.
BLOB = 1 << 16
NODE = ["depth", "f1", "f2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bases(attempt: int) -> tuple[int, int]:
    made = hashlib.sha256(f"bases {attempt}".encode()).digest()
    return tuple(int.from_bytes(made[i:i + 16], "big") % (PRIME - 2**32) + 2**32 for i in (0, 16))


def _turn_value(d1: int, d2: int) -> tuple[int, int]:
    return d1 % PRIME, d2 % PRIME


def _running(turns: DataFrame, bases: tuple[int, int]) -> tuple[DataFrame, dict[int, tuple]]:
    """Running products of each conversation within each partition, and what is carried into partitions.

    `turns` is (conv, turn, role, digest, len). A row: conv, part, its number j, product (h1, h2) and
    characters `cum` since the conversation began in this part, its turn's digest (d1, d2) and length.
    """
    order = ["conv", "turn", "role", "digest"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "kind int, part int, conv long, j long, h1 long, h2 long, cum long, d1 long, d2 long, len long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, conv, j, h1, h2, cum = TaskContext.get().partitionId(), None, None, 0, 0, 0, 0
        for batch in batches:
            rows = []
            for now, digest, length in zip(*(batch.column(n).to_pylist() for n in ("conv", "digest", "len"))):
                if now != conv:
                    conv, j, h1, h2, cum = now, 0, 0, 0, 0
                    if first is None:
                        first = now
                d1, d2 = int(digest[:16], 16), int(digest[16:32], 16)
                x1, x2 = _turn_value(d1, d2)
                j, h1, h2, cum = j + 1, (h1 * bases[0] + x1) % PRIME, (h2 * bases[1] + x2) % PRIME, cum + length
                rows.append((0, part, conv, j, h1, h2, cum, d1 - 2**63, d2 - 2**63, length))
            if rows:
                yield _batch(rows, kinds, names)
        if first is not None:  # the first conversation of the part, and how the last one stands
            yield _batch([(1, part, first, 0, 0, 0, 0, 0, 0, 0), (2, part, conv, j, h1, h2, cum, 0, 0, 0)], kinds, names)

    table = written(ordered.mapInArrow(run, schema), "running")
    ends = table.where("kind > 0").drop("d1", "d2", "len").orderBy("part", "kind").collect()  # two rows for each partition
    carried, held = {}, None
    for first, last in zip(ends[::2], ends[1::2]):
        into = held if held is not None and held[0] == first["conv"] else None
        if into is not None:
            carried[first["part"]] = into
        held = (last["conv"], last["j"], last["h1"], last["h2"], last["cum"])
        if into is not None and last["conv"] == first["conv"]:
            held = (held[0], *_joined(into[1:], held[1:], bases))
    return table.where("kind = 0").drop("kind"), carried


def _joined(a: tuple, b: tuple, bases: tuple[int, int]) -> tuple:
    """The element (length, h1, h2, characters) of two sequences one behind the other."""
    (m, a1, a2, x), (n, b1, b2, y) = a, b
    return m + n, (a1 * pow(bases[0], n, PRIME) + b1) % PRIME, (a2 * pow(bases[1], n, PRIME) + b2) % PRIME, x + y


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _whole(rows: DataFrame, carried: dict[int, tuple], bases: tuple[int, int]) -> DataFrame:
    """The rows of `_running` with numbers, products and characters since the conversation's first turn."""
    if not carried:
        return rows
    names = rows.columns
    kinds = [pa.int32()] + [pa.int64()] * (len(names) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                into = carried.get(row[0])
                if into is not None and into[0] == row[1]:
                    row = (*row[:2], *_joined(into[1:], row[2:6], bases), *row[6:])
                out.append(row)
            if out:
                yield _batch(out, kinds, names)

    return rows.mapInArrow(run, rows.schema)


def _members(rows: DataFrame, rebuilt: DataFrame, carried: dict[int, tuple], bases: tuple[int, int]) -> DataFrame:
    """One row for each conversation and depth: the node by depth and fingerprint, the node above, the last turn."""
    schema = ("conv long, depth long, f1 long, f2 long, p1 long, p2 long, d1 long, d2 long, len long, cum long, total_depth long, total_chars long")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * len(names)
    back = tuple(pow(b, -1, PRIME) for b in bases)
    own = rows.join(rebuilt.drop("head"), "conv").select(
        "part", "conv", "j", "h1", "h2", "cum", "d1", "d2", "len", "h", "n_head", "b1", "b2", "b_chars", "a1", "a2", "a_chars", "total_depth", "total_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, conv, j, h1, h2, cum, d1, d2, length, h, n_head, b1, b2, b_chars, a1, a2, a_chars, deep, chars in zip(*(c.to_pylist() for c in batch.columns)):
                into = carried.get(part)
                if into is not None and into[0] == conv:
                    j, h1, h2, cum = _joined(into[1:], (j, h1, h2, cum), bases)
                if j <= h:
                    continue
                # own product since turn h, behind the head's: h_j - a * B**n, then b * B**n before it
                f1 = (h1 + (b1 - a1) * pow(bases[0], j - h, PRIME)) % PRIME
                f2 = (h2 + (b2 - a2) * pow(bases[1], j - h, PRIME)) % PRIME
                x1, x2 = _turn_value(d1 + 2**63, d2 + 2**63)
                p1, p2 = (f1 - x1) * back[0] % PRIME, (f2 - x2) * back[1] % PRIME
                out.append((conv, n_head + j - h, f1, f2, p1, p2, d1, d2, length, b_chars + cum - a_chars, deep, chars))
            if out:
                yield _batch(out, kinds, names)

    zero = F.lit(0).cast("long")
    above = lambda field, i: F.when(i == 0, zero).otherwise(F.get("head", i - 1)[field])
    heads = rebuilt.select("conv", "total_depth", "total_chars", "head", F.posexplode("head").alias("i", "t")).select(
        "conv", F.col("t.j").alias("depth"), F.col("t.h1").alias("f1"), F.col("t.h2").alias("f2"), above("h1", F.col("i")).alias("p1"), above("h2", F.col("i")).alias("p2"),
        "t.d1", "t.d2", "t.len", "t.cum", "total_depth", "total_chars")
    roots = rebuilt.select("conv", *(zero.alias(n) for n in names[1:10]), "total_depth", "total_chars")
    return own.mapInArrow(run, schema).unionByName(heads).unionByName(roots)


def head_length(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from its base's beginning, and leaves out of its own."""
    return F.crc32(conv.cast("string")) % 6


def _rebuilt(whole: DataFrame) -> DataFrame:
    """Of each conversation: the head's turns (five at most) and product b, the own product a that the head replaces, length and characters."""
    none = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("j", "h1", "h2", "cum")))
    at = F.struct("j", "h1", "h2", "cum")
    h = head_length(F.col("conv"))
    own = whole.groupBy("conv").agg(F.max("j").alias("n"), F.max("cum").alias("chars"), F.max(F.when(F.col("j") <= h, at)).alias("a"))
    own = own.select("conv", "n", "chars", F.coalesce("a", none).alias("a"), h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    turn = F.struct("j", "h1", "h2", "cum", "len", "d1", "d2")
    heads = whole.where("conv % 100 = 0 AND j <= 5").groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    made = own.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast("array<struct<j:long,h1:long,h2:long,cum:long,len:long,d1:long,d2:long>>")))
    made = made.withColumn("n_head", F.size("head").cast("long"))
    b = F.when(F.col("n_head") > 0, F.get("head", F.col("n_head").cast("int") - 1))
    field = lambda name: F.coalesce(b[name], F.lit(0).cast("long"))
    return made.select(
        "conv", "h", "n_head", "head", field("h1").alias("b1"), field("h2").alias("b2"), field("cum").alias("b_chars"),
        F.col("a.h1").alias("a1"), F.col("a.h2").alias("a2"), F.col("a.cum").alias("a_chars"),
        (F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total_depth"),
        (field("cum") + F.col("chars") - F.col("a.cum")).alias("total_chars"))


def _end_digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes in which conversations end: a digest of their ids, ascending, with commas between."""
    ends = members.where("depth = total_depth").select(*NODE, "conv")
    order = [*NODE, "conv"]
    blobs = "depth long, f1 long, f2 long, first long, ids string"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in blobs.split(", ")], [pa.int64()] * 4 + [pa.string()]
        node, held, size, out = None, [], 0, []
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != node or size > BLOB:
                    if held:
                        out.append((*node, held[0], ",".join(map(str, held))))
                    node, held, size = now, [], 0
                held.append(conv)
                size += 8
            if out:
                yield _batch(out, kinds, names)
                out = []
        if held:
            yield _batch([(*node, held[0], ",".join(map(str, held)))], kinds, names)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*NODE, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
        node, digest, out = None, None, []
        for batch in batches:
            for *now, _first, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = now, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield _batch(out, kinds, names)
                out = []
        if node is not None:
            yield _batch([(*node, digest.hexdigest())], kinds, names)

    lists = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(listed, blobs)
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digested, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; see the module.

    A conversation's turns stand in the order of `turn`, nulls first; turns of one number by role,
    then by the SHA-256 of role and text. Null roles and texts are empty, rows without a conversation belong
    to none. Conversation c becomes the first h turns of conversation c - c % 100 (fewer if it has fewer, none
    if it is absent), then its own behind its first h; h is `head_length`. A node is a distinct sequence
    of first turns, by role and text; the root, of depth 0, has all conversations, also those that lose
    all turns. Result: conv_id (the node's smallest member), depth, parent_conv_id (the smallest of the
    node above, null for the root), n_convs, n_children, n_leaves, saved_tokens (the characters of last turns
    that need not be kept once more, summed over the subtree), ends_sha256 (of the conversations that end
    here). Repeated rows are repeated turns. An empty table gives no rows; other columns are not read.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    content = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)
    turns = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), F.sha2(content, 256).alias("digest"), F.length(text_).cast("long").alias("len"))
    attempt = 0
    while True:
        bases = _bases(attempt)
        rows, carried = _running(turns, bases)
        rebuilt = written(_rebuilt(_whole(rows, carried, bases)), "rebuilt")
        members = written(_members(rows, rebuilt, carried, bases), "members")
        nodes = written(members.groupBy(*NODE).agg(
            F.min("conv").alias("owner"), F.max("total_depth").alias("deepest"), F.max("cum").alias("cum"), F.max("len").alias("len"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
            (F.min("d1").eqNullSafe(F.max("d1")) & F.min("d2").eqNullSafe(F.max("d2"))).alias("same")), "nodes")
        if nodes.where("NOT same").isEmpty():
            break
        attempt += 1
    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(
        F.min(F.struct("depth", (F.col("cum") - F.col("len")).alias("before"), "p1", "p2")).alias("top"), F.sum((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf"))
    owned = written(owned.select("conv", "leaf", F.col("top.depth").alias("since"), F.col("top.before").alias("before"), F.col("top.p1").alias("p1"), F.col("top.p2").alias("p2")), "owned")
    above = nodes.select((F.col("depth") + 1).alias("since"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("owner").alias("up"))
    facts = owned.join(above, ["since", "p1", "p2"], "left").select("conv", "leaf", "since", "before", "up")
    # Conversations that own no node have an equal of a smaller number.
    met = members.join(facts, "conv", "left")
    depth, never = F.col("depth"), F.lit(2**62)
    since = F.coalesce("since", never)
    spare = F.col("total_chars") - (F.col("cum") - F.col("len")) - F.when(F.col("since").isNotNull(), F.col("total_chars") - F.col("before")).otherwise(0)
    made = met.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(since < depth, F.col("conv")).when(since == depth, F.col("up"))).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(((since <= depth + 1) & (depth < F.col("total_depth"))).cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.when(since <= depth, 0).otherwise(spare)).cast("long").alias("saved_tokens"))
    made = made.join(_end_digests(members), NODE, "left")
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
