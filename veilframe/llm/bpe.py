"""Byte-level BPE encoding and decoding, by recursive queries over token-position rows.

A text is cut into words by the tokenizer's pattern. Each task keeps the words it has met;
new ones become rows (word, position, token) in an in-process DuckDB, of which a worker has one,, join the merge table
(left token, right token, merged token), and a recursive query contracts each word's leftmost
pair of minimum rank until no pair merges. Decoding joins the tokens of a block of texts with
the vocabulary and aggregates their bytes in the order of positions. Both are projections of
rows: no shuffle, and memory bounded by the block and by `CACHE_WORDS`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from veilframe.llm.common import held, map_texts

#: Words kept in each of two generations of a worker's cache; older ones are encoded again when they recur.
CACHE_WORDS = 220_000
#: Rows (bytes of words) that one recursive query starts with; a longer word is a block of its own.
BLOCK_BYTES = 200_000
#: Texts and bytes of text whose new words are learned together: fewer, larger recursive queries.
BATCH_TEXTS, BATCH_BYTES = 2048, 2 << 20
#: Tokens that one decoding query takes; a longer text is a block of its own.
BLOCK_TOKENS = 250_000
#: Longer words are contracted in all places of the minimum rank at once, where that is provably the same: the result does not depend on this length.
LONG_WORD = 256
MEMORY = "250MB"

#: What \s, \p{L} and \p{N} mean in the tokenizer's own dialect for text of the
#: characters that SIMPLE allows; there a pattern of plain ranges gives the same words faster.
SIMPLE = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ]")
SIMPLE_CLASSES = (
    (r"[^\s\p{L}\p{N}]", "[!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷]"),
    (r"\p{L}", "[a-zA-ZªµºÀ-ÖØ-öø-ɏ]"),
    (r"\p{N}", "[0-9]"),
)
SPACES = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

VOCAB = """
CREATE TABLE vocab AS
SELECT from_base64(split_part(line, ' ', 1)) AS bytes, CAST(split_part(line, ' ', 2) AS INTEGER) AS id
FROM read_csv(?, columns = {'line': 'VARCHAR'}, delim = '\t', header = false, quote = '', escape = '')
"""
#: The rank of a pair is the rank of the bytes of both; several pairs may make one token.
MERGES = """
CREATE TABLE merges AS
WITH cuts AS (SELECT id, hex(bytes) AS h, unnest(generate_series(1, octet_length(bytes) - 1)) AS at
              FROM vocab WHERE octet_length(bytes) > 1),
     names AS (SELECT id, hex(bytes) AS h FROM vocab)
SELECT l.id AS l, r.id AS r, c.id AS merged
FROM cuts c JOIN names l ON l.h = substr(c.h, 1, 2 * c.at) JOIN names r ON r.h = substr(c.h, 2 * c.at + 1)
"""
#: A row's place is its word times 65536 plus its position; the least of rank, position, next position is the pair to contract.
CONTRACT = """
WITH RECURSIVE step(place, token, round) AS (
  SELECT word * 65536::BIGINT + pos, token, 0 FROM start
  UNION ALL
  SELECT * FROM (
    WITH pairs AS (SELECT place, token, lead(token) OVER w AS after, lead(place) OVER w AS after_place
                   FROM step WINDOW w AS (ORDER BY place)),
         best AS (SELECT place >> 16 AS word,
                         min(merged * 4294967296::BIGINT + (place & 65535) * 65536 + (after_place & 65535)) AS pair
                  FROM pairs JOIN merges m ON m.l = token AND m.r = after
                  WHERE place >> 16 = after_place >> 16 GROUP BY 1)
    SELECT s.place, CASE WHEN s.place & 65535 = (b.pair >> 16) & 65535 THEN (b.pair >> 32)::INTEGER ELSE s.token END,
           s.round + 1
    FROM step s JOIN best b ON b.word = s.place >> 16 WHERE s.place & 65535 <> b.pair & 65535)
)
SELECT CAST(word AS INTEGER) AS word, list(token ORDER BY place) AS ids
FROM (SELECT *, place >> 16 AS word, max(round) OVER (PARTITION BY place >> 16) AS last FROM step)
WHERE round = last GROUP BY word
"""
#: As CONTRACT, in fewer rounds: if no pair that a contraction makes has a lower rank than the
#: contracted one, the next leftmost pair of minimum rank is the next place of the same rank.
#: Places that overlap form runs, of which every other one counts from the left.
CONTRACT_RUNS = """
WITH RECURSIVE step(word, pos, token, round) AS (
  SELECT word, pos, token, 0 FROM start
  UNION ALL
  SELECT * FROM (
    WITH pairs AS (SELECT word, pos, token, row_number() OVER w AS place, lead(token) OVER w AS after,
                          lead(pos) OVER w AS after_pos, lag(token) OVER w AS before,
                          lead(token, 2) OVER w AS after2
                   FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)),
         ranked AS (SELECT p.*, m.merged FROM pairs p JOIN merges m ON m.l = p.token AND m.r = p.after),
         least AS (SELECT word, min(merged) AS merged FROM ranked GROUP BY word),
         places AS (SELECT r.*, r.place - row_number() OVER (PARTITION BY r.word ORDER BY r.place) AS run
                    FROM ranked r JOIN least USING (word, merged)),
         made AS (SELECT DISTINCT word, merged, before AS l, merged AS r FROM places WHERE before IS NOT NULL
                  UNION SELECT DISTINCT word, merged, merged, after2 FROM places WHERE after2 IS NOT NULL
                  UNION SELECT DISTINCT word, merged, merged, merged FROM places),
         lower AS (SELECT DISTINCT word FROM made JOIN merges m USING (l, r) WHERE m.merged < made.merged),
         chosen AS (SELECT word, pos, after_pos, merged FROM
                     (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY place) AS in_run,
                             row_number() OVER (PARTITION BY word ORDER BY place) AS in_word FROM places)
                    WHERE in_run % 2 = 1 AND (in_word = 1 OR word NOT IN (SELECT word FROM lower)))
    SELECT s.word, s.pos, coalesce(c.merged, s.token), s.round + 1
    FROM step s LEFT JOIN chosen c ON c.word = s.word AND c.pos = s.pos
    WHERE s.word IN (SELECT word FROM chosen)
      AND NOT EXISTS (SELECT 1 FROM chosen d WHERE d.word = s.word AND d.after_pos = s.pos)
  )
)
SELECT word, list(token ORDER BY pos) AS ids
FROM (SELECT *, max(round) OVER (PARTITION BY word) AS last FROM step) WHERE round = last GROUP BY word
"""
DECODE = """
SELECT t.doc, list(v.bytes ORDER BY t.pos) AS parts, count(v.id) AS known, count(*) AS n
FROM tokens t LEFT JOIN vocab v USING (id) GROUP BY t.doc
"""


class _Vocabulary:
    """Of one worker: the database with the vocabulary; both directions share it."""

    def __init__(self, ranks: str) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        self.con.execute(VOCAB, [ranks])

    def close(self) -> None:
        self.con.close()


def _vocabulary(ranks: str) -> _Vocabulary:
    return held("bpe", ranks, lambda: _Vocabulary(ranks))


class _Encoder:
    """Of one worker: the merge table and the words met of late."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex

        self.con = _vocabulary(ranks).con
        self.con.execute(MERGES.replace("CREATE TABLE", "CREATE TABLE IF NOT EXISTS"))
        singles = self.con.execute("SELECT bytes, id FROM vocab WHERE octet_length(bytes) = 1").fetchall()
        self.byte_ids = np.full(256, -1, np.int32)
        for b, i in singles:
            self.byte_ids[b[0]] = i
        whole = self.con.execute("SELECT bytes, id FROM vocab").fetchall()
        self.whole = {bytes(b): i for b, i in whole}
        simple = pattern
        for name, plain in SIMPLE_CLASSES:
            simple = simple.replace(name, plain)
        self.simple = None if r"\p" in simple else re.compile(simple)
        self.full = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.simple is not None and not SIMPLE.search(text):
            return self.simple.findall(text)
        return [m.group() for m in self.full.finditer(text)]

    def learn(self, words: list[str]) -> None:
        block: list[tuple[str, bytes]] = []
        size = 0
        for word in words:
            raw = word.encode("utf-8")
            if raw in self.whole:  # a word that is a token stays one token
                self.young[word] = self.whole[raw].to_bytes(4, "little")
                continue
            if block and size + len(raw) > BLOCK_BYTES:
                self.contract(block)
                block, size = [], 0
            if len(raw) > LONG_WORD:
                self.contract([(word, raw)])
                continue
            block.append((word, raw))
            size += len(raw)
        if block:
            self.contract(block)

    def contract(self, block: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(raw) for _, raw in block], np.int64)
        longest = lengths.max()
        tokens = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in block), np.uint8)]
        word = np.repeat(np.arange(len(block), dtype=np.int32), lengths)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.con.register("start", pa.table({"word": word, "pos": pos.astype(np.int32), "token": tokens}))
        made = self.con.sql(CONTRACT if longest <= LONG_WORD else CONTRACT_RUNS).to_arrow_table().combine_chunks()
        self.con.unregister("start")
        ids = made.column("ids").chunk(0)
        flat, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        for at, w in enumerate(made.column("word").to_pylist()):
            self.young[block[w][0]] = flat[ends[at]:ends[at + 1]].tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        met = set().union(*cut)
        new = []
        for word in met:
            if word not in self.young:
                known = self.old.get(word)
                if known is None:
                    new.append(word)
                else:
                    self.young[word] = known
        self.learn(new)
        ids = [b"".join(map(self.young.__getitem__, words)) for words in cut]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return ids


def _encoder(ranks: str, pattern: str) -> _Encoder:
    return held("bpe", (ranks, pattern), lambda: _Encoder(ranks, pattern))


def encode(df: DataFrame, ranks: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys and `ids` (binary): the token ids of each text as little-endian unsigned 32-bit integers.

    `ranks` is the place of a rank file (base64 token, blank, rank) on every worker, `pattern`
    the tokenizer's splitting pattern. Special tokens are ordinary text. Null and empty texts
    have no ids; repeated rows are encoded alike; an empty table stays empty; columns other
    than the keys and the text are ignored.
    """

    def make():
        encoder = _encoder(ranks, pattern)
        return lambda texts: [pa.array(encoder.encode([t or "" for t in texts]), pa.binary())]

    return map_texts(df, keys, text, [T.StructField("ids", T.BinaryType())], make, rows=BATCH_TEXTS, chars=BATCH_BYTES)


def _decode_block(con, rows: list[tuple[int, np.ndarray]], out: list[bytes]) -> None:
    lengths = np.array([len(ids) for _, ids in rows], np.int64)
    if not lengths.sum():
        return
    doc = np.repeat(np.array([at for at, _ in rows], np.int32), lengths)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids = np.concatenate([ids for _, ids in rows]).astype(np.int64)
    con.register("tokens", pa.table({"doc": doc, "pos": pos.astype(np.int32), "id": ids}))
    made = con.sql(DECODE).to_arrow_table().combine_chunks()
    con.unregister("tokens")
    if made.column("known").to_pylist() != made.column("n").to_pylist():
        raise ValueError("a token id that is not in the vocabulary")
    parts = made.column("parts").chunk(0)
    values, ends = parts.values, parts.offsets.to_numpy()
    blob = values.buffers()[2]
    starts = np.frombuffer(values.buffers()[1], np.int32 if values.type == pa.binary() else np.int64)
    for at, doc_at in enumerate(made.column("doc").to_pylist()):
        # the parts of one text lie one behind the other, so they are one piece of the value buffer
        out[doc_at] = blob.slice(starts[ends[at] + values.offset], starts[ends[at + 1] + values.offset] - starts[ends[at] + values.offset]).to_pybytes()


def _decoded(ranks: str, packed: list) -> list[bytes]:
    con = _vocabulary(ranks).con
    out: list[bytes] = [b""] * len(packed)
    block, size = [], 0
    for at, raw in enumerate(packed):
        one = np.frombuffer(raw or b"", "<u4")
        if block and size + len(one) > BLOCK_TOKENS:
            _decode_block(con, block, out)
            block, size = [], 0
        block.append((at, one))
        size += len(one)
    _decode_block(con, block, out)
    return out


def decode(df: DataFrame, ranks: str, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The keys and `decoded` (binary): the bytes of the tokens, in their order.

    Null and empty ids give no bytes. An id that is not in the vocabulary is an error.
    """
    return map_texts(df, keys, ids, [T.StructField("decoded", T.BinaryType())], lambda: lambda packed: [pa.array(_decoded(ranks, packed), pa.binary())], kind="binary")


def round_trip(df: DataFrame, ranks: str, pattern: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The keys, `ids` and `decoded`: encoding and decoding in one pass, so that a task has one worker."""

    def make():
        encoder = _encoder(ranks, pattern)

        def work(texts: list) -> list[pa.Array]:
            ids = encoder.encode([t or "" for t in texts])
            return [pa.array(ids, pa.binary()), pa.array(_decoded(ranks, ids), pa.binary())]

        return work

    return map_texts(df, keys, text, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())], make, rows=BATCH_TEXTS, chars=BATCH_BYTES)
