"""Repair of damaged conversations: least-cost edits, and of these the alphabetically least list.

An edit list is a path over nodes (row, state). The state is what the kept roles say so far:
nothing, a system turn, a user turn that waits for its answer, or an answered one. Arcs spell
the list: D leaves a row out, I puts an empty turn in, K keeps a row, R gives it the other role;
out of one node each letter leads to one node, as the state tells which role fits.

1. Cost DP: every row is a 4 x 4 matrix of costs between states. Suffix products are made by
   doubling for all rows of a batch at once; a block of a conversation has its product, and what
   the blocks behind it cost is carried back over blocks.
2. Optimal arcs are those that lose nothing. They are the nodes of a ranking: each is ranked by
   the first 1, 2, 4, ... letters of its least path, from the ranks of two halves, and its
   pointer over so many letters is doubled with it. Ranks choose the successor at each state;
   pointers list the path of a block in as many steps as its length has digits.
3. Which state a block begins in follows from the blocks before it. Texts meet their edits in
   order of place and go, in pieces, to the digest of their conversation.

Rows are sorted over all partitions and cut into blocks of at most BLOCK rows, so one
conversation may hold most rows: only its blocks' products, and its result, which is one value,
come together in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veilframe.llm.common import written

#: Rows (of the sorted table) that a block has at most; a power of two.
BLOCK_BITS = 12
#: Characters of repaired text that are one row on the way to the digest.
PIECE = 1 << 20
#: Rows times states that are ranked at once.
AT_ONCE = 1 << 14

START, SYSTEM, USER, ANSWERED = range(4)
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
FAR = np.int64(1 << 40)
BLANKS = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What a turn of each initial (s, u, a, other) leads to from each state; -1 is not allowed.
BY_INITIAL = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ANSWERED, -1], [-1, USER, -1, -1]])
#: The only turn of a user or assistant that fits each state.
FITTING = np.array([USER, USER, ANSWERED, USER])
FITTING_ROLE = ("user", "user", "assistant", "user")
INSERT_COST, DELETE_COST, REROLE_COST, TRUNCATED_COST = 5, 2, 1, 5


def _row_costs(code: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """(rows, states, letters) costs of D, K and R; that of I is the same everywhere."""
    cost = np.full((len(code), 4, 4), FAR)
    cost[:, :, DELETE] = DELETE_COST
    stays = (fault == OK) | (fault == TRUNCATED)
    extra = np.where(fault == TRUNCATED, TRUNCATED_COST, 0)[:, None]
    cost[:, :, KEEP] = np.where(stays[:, None] & (BY_INITIAL[:, code].T >= 0), extra, FAR)
    cost[:, :, REROLE] = np.where(stays[:, None], extra + REROLE_COST, FAR)
    cost[:, :, INSERT] = INSERT_COST
    return cost


def _inserted(matrix: np.ndarray) -> np.ndarray:
    """A matrix (states to anything) with any number of turns put in before it."""
    for _ in range(3):  # more than three never cost least
        matrix = np.minimum(matrix, matrix[:, FITTING] + INSERT_COST)
    return matrix


def _row_matrices(code: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """(rows, states before, states after)."""
    made = np.full((len(code), 4, 4), FAR)
    for s in range(4):
        made[:, s, s] = cost[:, s, DELETE]
        made[:, s, FITTING[s]] = np.minimum(made[:, s, FITTING[s]], cost[:, s, REROLE])
        to = BY_INITIAL[s][code]
        at = np.flatnonzero(to >= 0)
        made[at, s, to[at]] = np.minimum(made[at, s, to[at]], cost[at, s, KEEP])
    return _inserted(made)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices in costs: the least sum over the state between."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


IDENTITY = np.where(np.eye(4, dtype=bool), np.int64(0), FAR)


def _suffixes(matrices: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row the product of the matrices from it to the end (exclusive) of its block, by doubling."""
    place = np.arange(len(matrices))
    made, reach = matrices, 1
    longest = int((end - place).max(initial=0))
    while reach < longest:
        more = np.flatnonzero(place + reach < end)
        joined = made.copy()
        joined[more] = _product(made[more], made[more + reach])
        made, reach = joined, reach * 2
    return made


#: What each state costs behind a conversation's last row, where turns may still be put in.
ACCEPTING = _inserted(np.array([[0], [FAR], [FAR], [0]], np.int64)[None])[0, :, 0]


def solve(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]) -> list[list[tuple[str, int]]]:
    """The least edits of each block from each state: (letters, state behind it); see the module.

    A block: codes and faults of its rows, the costs from each state behind it to the end of its
    conversation, and whether it is the last one (turns may be put in behind its last row).
    """
    # A slot for each row and one behind each block, from which only insertions lead on.
    sizes = np.array([len(b[0]) + 1 for b in blocks])
    end = np.cumsum(sizes)
    begin = end - sizes
    n = int(end[-1])
    code, fault = np.full(n, 3), np.full(n, BLANK)
    tail = np.zeros(n, bool)
    tail[end - 1] = True
    for (c, f, _, _), at in zip(blocks, begin):
        code[at:at + len(c)], fault[at:at + len(c)] = c, f
    block_end = np.repeat(end, sizes)
    cost = _row_costs(code, fault)
    cost[tail] = FAR
    cost[end[[b[3] for b in blocks]] - 1, :, INSERT] = INSERT_COST
    behind = np.repeat(np.stack([b[2] for b in blocks]), sizes, axis=0)
    left = np.empty((n, 4), np.int64)
    rows = np.flatnonzero(~tail)
    if len(rows):
        dense = np.cumsum(~tail) - 1
        products = _suffixes(_row_matrices(code[rows], cost[rows]), dense[block_end[rows] - 1] + 1)
        left[rows] = np.minimum((products + behind[rows][:, None, :]).min(axis=2), FAR)
    left[tail] = behind[tail]
    # Arcs (slot, state, letter): where they lead, and whether they lose nothing.
    slot, state = np.divmod(np.arange(n * 4), 4)
    to = np.full((n * 4, 4), -1)
    below = np.where(tail[slot], -1, (slot + 1) * 4)
    to[:, DELETE] = np.where(below >= 0, below + state, -1)
    to[:, INSERT] = slot * 4 + FITTING[state]
    to[:, REROLE] = np.where(below >= 0, below + FITTING[state], -1)
    kept = BY_INITIAL[state, code[slot]]
    to[:, KEEP] = np.where((below >= 0) & (kept >= 0), below + kept, -1)
    paid = cost.reshape(n * 4, 4)
    remaining = left.reshape(-1)
    tight = (to >= 0) & (paid < FAR) & (remaining[:, None] < FAR) & (paid + remaining[to] == remaining[:, None])
    arcs = np.flatnonzero(tight.reshape(-1))
    node, letter = np.divmod(arcs, 4)
    index = np.full(n * 16, len(arcs))
    index[arcs] = np.arange(len(arcs))
    target = to.reshape(-1)[arcs]
    rank = np.append(letter + 1, 0)  # the end of a path is the last of all and ranks before all

    def least(ranks: np.ndarray) -> np.ndarray:
        """The arc of least rank out of each node, or the end."""
        table = np.where(tight, ranks[np.minimum(index, len(arcs))].reshape(n * 4, 4), np.iinfo(np.int64).max)
        best = table.argmin(axis=1)
        return np.where(tight.any(axis=1), index[np.arange(n * 4) * 4 + best], len(arcs))

    # Letters out of one node differ, so that the successor is known from ranks of one letter on.
    jump = np.append(least(rank)[target], len(arcs))
    jumps, length = [jump], 1
    longest = 3 * int(sizes.max()) + 4
    while length < longest:
        _, rank = np.unique(rank * (len(arcs) + 2) + rank[jump], return_inverse=True)
        jump = jump[jump]
        jumps.append(jump)
        length *= 2
    first = least(rank)[(begin[:, None] * 4 + np.arange(4)).reshape(-1)]
    path = first[:, None]
    for jump in jumps:  # twice as many arcs with each pointer
        if (path[:, -1] == len(arcs)).all():
            break
        path = np.concatenate([path, jump[path]], axis=1)
    spelled = np.append(letter, 4)[path].astype(np.uint8)
    lengths = (path < len(arcs)).sum(axis=1)
    text = np.frombuffer(b"DIKR ", np.uint8)[spelled]
    leaves = np.append(target % 4, 0)
    out = []
    for i in range(len(blocks)):
        variants = []
        for s in range(4):
            at = i * 4 + s
            m = int(lengths[at])
            variants.append((text[at, :m].tobytes().decode(), int(leaves[path[at, m - 1]]) if m else s))
        out.append(variants)
    return out


def damaged(rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """The rows of (conv, turn, role, text) with a fault in some, by a checksum of conversation and turn; nulls are one space.

    Of the checksum modulo 20: 0 drops a row (it stays with a null text), 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    text = F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(conv, turn, F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.col("role").alias("given"), F.explode(copies).alias("copy"))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_INT, _TEXT, _BYTES = pa.int64(), pa.string(), pa.binary()
SEGMENT = [("conv", _TEXT), ("place", _INT), ("block", _INT), ("codes", _BYTES), ("product", pa.list_(_INT)), ("blank", _INT), ("duplicate", _INT), ("truncated", _INT),
           ("illegal", _INT), ("first_code", _INT), ("last_code", _INT), ("low", _INT), ("high", _INT), ("turns", _INT)]
SEGMENT_DDL = ("conv string, place long, block long, codes binary, product array<long>, blank long, duplicate long, truncated long, illegal long, first_code long, "
               "last_code long, low long, high long, turns long")
GONE = 255
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _segments(flagged: DataFrame) -> DataFrame:
    """One row for each block of a conversation: its rows' codes, faults, turns and product of costs."""

    def finished(held: list[tuple]) -> list[tuple]:
        made, ends, matrices = [], [], []
        for conv, place, codes, turns in held:
            both = np.frombuffer(bytes(codes), np.uint8)
            both = both[both != GONE]
            code, fault = both & 3, both >> 2
            matrices.append(_row_matrices(code, _row_costs(code, fault)))
            ends.append(len(code))
            illegal = sum((int(a), int(b)) not in LEGAL for a, b in zip(code[:-1], code[1:]))
            count = np.bincount(fault, minlength=4)
            met = [t for t in turns if t is not None]
            made.append([conv, place, place >> BLOCK_BITS, bytes(codes), None, int(count[BLANK]), int(count[DUPLICATE]), int(count[TRUNCATED]), illegal,
                         int(code[0]) if len(code) else None, int(code[-1]) if len(code) else None, met[0] if met else None, met[-1] if met else None,
                         sum(a != b for a, b in zip(met[:-1], met[1:])) + (len(met) > 0)])
        ends = np.array(ends)
        stop = np.cumsum(ends)
        products = _suffixes(np.concatenate(matrices), np.repeat(stop, ends))
        for row, n, e in zip(made, ends, stop):
            row[4] = (products[e - n] if n else IDENTITY).reshape(-1).tolist()
        return [tuple(r) for r in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, rows = None, 0
        for batch in batches:
            for conv, place, code, turn in zip(*(batch.column(n).to_pylist() for n in ("conv", "place", "code", "turn"))):
                if at != (conv, place >> BLOCK_BITS):
                    if rows >= AT_ONCE:
                        yield _batch(finished(held), SEGMENT)
                        held, rows = [], 0
                    at = (conv, place >> BLOCK_BITS)
                    held.append((conv, place, bytearray(), []))
                held[-1][2].append(code)
                if code != GONE:
                    held[-1][3].append(turn)
                rows += 1
        if held:
            yield _batch(finished(held), SEGMENT)

    ordered = flagged.repartition(F.col("block")).sortWithinPartitions("place").select("conv", "place", "code", "turn")
    return ordered.mapInArrow(run, SEGMENT_DDL)


BEHIND = [("place", _INT), ("behind", pa.list_(_INT)), ("last", pa.bool_())]
TOTALS = [("gaps", _INT), ("blank", _INT), ("duplicate", _INT), ("truncated", _INT), ("illegal", _INT), ("cost", _INT)]


def _carried_back(segments: DataFrame) -> DataFrame:
    """(place, behind, last) of each block, and with a conversation's first block its totals: what each state behind it costs to the end."""
    schema = BEHIND + TOTALS

    def finished(rows: list[dict]) -> list[tuple]:
        out, behind = [], ACCEPTING
        for i, row in reversed(list(enumerate(rows))):
            out.append([row["place"], behind.tolist(), i == len(rows) - 1] + [None] * len(TOTALS))
            behind = np.minimum((np.array(row["product"]).reshape(4, 4) + behind[None, :]).min(axis=1), FAR)
        full = [r for r in rows if r["first_code"] is not None]
        met = [r for r in full if r["turns"]]
        turns = sum(r["turns"] for r in met) - sum(a["high"] == b["low"] for a, b in zip(met[:-1], met[1:]))
        illegal = sum(r["illegal"] for r in full) + sum((a["last_code"], b["first_code"]) not in LEGAL for a, b in zip(full[:-1], full[1:]))
        gaps = met[-1]["high"] - met[0]["low"] + 1 - turns if met else 0
        out[-1][len(BEHIND):] = [gaps, *(sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated")), illegal, int(behind[START])]
        return [tuple(r) for r in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["conv"] != row["conv"]:
                    out.extend(finished(held))
                    held = []
                held.append(row)
            if out:
                yield _batch(out, schema)
                out = []
        if held:
            yield _batch(finished(held), schema)

    slim = segments.drop("codes", "block").repartition("conv").sortWithinPartitions("conv", "place")
    return slim.mapInArrow(run, "place long, behind array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


SOLVED = [("conv", _TEXT), ("place", _INT), ("block", _INT), ("audits", pa.list_(_TEXT)), ("leaves", pa.list_(_INT))]


def _solved(segments: DataFrame, behind: DataFrame) -> DataFrame:
    """The least edits of each block from each state that it may begin in."""
    joined = segments.select("conv", "place", "block", "codes").join(behind.select("place", "behind", "last"), "place")

    def finished(rows: list[dict]) -> list[tuple]:
        blocks = []
        for r in rows:
            both = np.frombuffer(r["codes"], np.uint8)
            both = both[both != GONE]
            blocks.append((both & 3, both >> 2, np.array(r["behind"]), r["last"]))
        return [(r["conv"], r["place"], r["block"], [a for a, _ in v], [s for _, s in v]) for r, v in zip(rows, solve(blocks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: len(r["codes"]))
            held, longest = [], 0
            for r in rows:  # blocks of like length together: their paths are one table
                longest = len(r["codes"]) + 1
                if held and (len(held) + 1) * longest > AT_ONCE:
                    yield _batch(finished(held), SOLVED)
                    held = []
                held.append(r)
            if held:
                yield _batch(finished(held), SOLVED)

    return joined.mapInArrow(run, "conv string, place long, block long, audits array<string>, leaves array<long>")


CHOSEN = [("block", _INT), ("place", _INT), ("conv", _TEXT), ("audit", _TEXT), ("state", _INT)]


def _chosen(solved: DataFrame) -> DataFrame:
    """Of each block the edits from the state that the blocks before it leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, START
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != conv:
                    conv, state = row["conv"], START
                out.append((row["block"], row["place"], conv, row["audits"][state], state))
                state = row["leaves"][state]
            if out:
                yield _batch(out, CHOSEN)

    return solved.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(run, "block long, place long, conv string, audit string, state long")


PIECES = [("conv", _TEXT), ("place", _INT), ("no", _INT), ("audit", _TEXT), ("body", _TEXT)]


def _pieces(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired text of each block, every turn closed by a line feed, in pieces; the first piece has the block's edits."""
    edits = chosen.select("block", "place", F.lit(0).alias("kind"), "conv", "audit", "state", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("block", "place", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("conv"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("state"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = place = audit = None
        at, state, no, body, size = 0, START, 0, [], 0

        def piece() -> tuple:
            return conv, place, no, audit if no == 0 else "", "".join(body)

        def add(role: str, text: str) -> None:
            nonlocal size
            body.append(f"{role}:{text}\n")
            size += len(body[-1])

        def put_in() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                add(FITTING_ROLE[state], "")
                at, state = at + 1, int(FITTING[state])

        for batch in batches:
            out = []
            for kind, where, name, letters, begins, role, text in zip(*(batch.column(n).to_pylist() for n in ("kind", "place", "conv", "audit", "state", "role", "text"))):
                if kind == 0:
                    if conv is not None:
                        put_in()
                        out.append(piece())
                    conv, place, audit, state, at, no, body, size = name, where, letters, begins, 0, 0, [], 0
                    continue
                if text is None:  # the row that was dropped
                    continue
                put_in()
                letter, at = audit[at], at + 1
                if letter == "K":
                    add(role, text)
                    state = int(BY_INITIAL[state, code_of(role)])
                elif letter == "R":
                    add(FITTING_ROLE[state], text)
                    state = int(FITTING[state])
                if size > PIECE:
                    out.append(piece())
                    no, body, size = no + 1, [], 0
            if out:
                yield _batch(out, PIECES)
        if conv is not None:
            put_in()
            yield _batch([piece()], PIECES)

    ordered = edits.unionByName(texts).repartition("block").sortWithinPartitions("block", "place", "kind")
    # A block has rows of several conversations: each one's edits stand before its first row.
    return ordered.mapInArrow(run, "conv string, place long, no long, audit string, body string")


def code_of(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else 3


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits one behind the other, and a digest of the texts with line feeds between turns."""
    schema = [("conv", _TEXT), ("audit", _TEXT), ("repaired_sha256", _TEXT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, held = None, [], None, b""
        for batch in batches:
            out = []
            for name, _, _, letters, body in zip(*(batch.column(n).to_pylist() for n, _ in PIECES)):
                if name != conv:
                    if conv is not None:
                        digest.update(held[:-1])
                        out.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, held = name, [], hashlib.sha256(), b""
                audit.append(letters)
                if body:
                    digest.update(held)
                    held = body.encode("utf-8", "surrogatepass")
            if out:
                yield _batch(out, schema)
        if conv is not None:
            digest.update(held[:-1])
            yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)

    return pieces.repartition("conv").sortWithinPartitions("conv", "place", "no").mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def _code(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def _placed(turns: DataFrame) -> DataFrame:
    """The turns sorted over all partitions, with their place in this order and its block; written."""
    source = turns.withColumn("content", F.sha2(F.col("text"), 256)).withColumn("source", F.monotonically_increasing_id())
    order = ["conv", "turn", "given", "content", "copy", "source"]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(ordered.select("conv", "turn", "role", "text", "place", F.shiftright("place", BLOCK_BITS).alias("block")), "turns")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair the conversations of (conv string, turn, role, text, given, copy), as `damaged` gives them: (rows, edits, totals).

    Null roles are not allowed; a null text is a row that is not there. Edits: (block, place, conv, audit, state), totals:
    (conv, gaps, blank, duplicate, truncated, illegal, cost).
    """
    rows = _placed(turns)
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select("conv", "turn", "place", "block", "text", _code(F.col("role")).alias("initial"), (trimmed == "").alias("blank"),
                       (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"))
    # The first row of each content in its conversation, aggregated in the map; places are unique.
    firsts = slim.where(F.col("text").isNotNull()).groupBy("conv", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    flagged = slim.drop("text", "content").join(firsts, "place", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(OK)
    code = F.when(F.col("blank").isNull(), GONE).otherwise(F.col("initial") + fault * 4)
    segments = written(_segments(flagged.select("conv", "place", "block", F.col("turn").cast("long").alias("turn"), code.alias("code"))), "segments")
    behind = written(_carried_back(segments), "behind")
    chosen = _chosen(_solved(segments, behind))
    totals = segments.select("conv", "place").join(behind.where("cost IS NOT NULL"), "place").drop("place", "behind", "last")
    return rows, chosen, totals


def repaired_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage conversations (see `damaged`), repair them, and tell how: one row for each conversation of the table.

    Rows stand in the order of `turn`, nulls first, those of one turn by role and then the SHA-256 of their text. The
    first fault of a row counts: blank, duplicate (same role and text before in its conversation), truncated
    (its last character, but for blanks, ends no sentence). Null roles and texts are one space, an empty role fits
    nowhere; rows without a conversation are one, of null. A conversation whose rows are all dropped has zeros,
    no edits and the digest of an empty text. Result: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Repeated rows are duplicates. An empty table gives no rows; other columns are not read.
    """
    kind = df.schema[conv].dataType
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv}`").cast("string").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    # A conversation's name is never null from here on.
    named = damaged(rows, "conv", "turn").withColumn("conv", F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")))
    turns, chosen, totals = repair(named)
    made = totals.join(_digests(_pieces(turns, chosen)), "conv")
    back = F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(kind).alias(conv)
    return made.select(back, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
