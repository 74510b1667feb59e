import base64
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from veilframe.llm import bpe  # noqa: E402
from veilframe.llm.queries import BPE_RANKS, bpe_files  # noqa: E402


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(BPE_RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    odd = ["", " ", "a\x1cb \x1c\x1d c", "x\x85y  z ", "²³ 1½ ٣٤ ⅷ", "日本語 テスト", "नमस्ते दुनिया", "👩‍👩‍👧 🇩🇪", "\r\n\r\n  a\t\tb   c", "it's IT'S they'll",
           "<|endoftext|>", "\0\0", "a" * 3000, "ab" * 2000, "=-" * 700, "".join(rng.choice("abcdefgh") for _ in range(3000))]
    return odd + ["".join(rng.choice("the and ionéß -=12\n") for _ in range(rng.randint(1, 200))) for _ in range(100)]


def test_same_ids_as_the_library_and_back(frame, library):
    rows = list(enumerate(texts())) + [(10_000, None), (None, "null key"), (7, "repeated"), (7, "repeated")]
    df = frame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    ranks, pattern = bpe_files()
    ids = bpe.encode(df, ranks, pattern, ("doc_id", "text"))
    for r in bpe.decode(ids, ranks, ("text", "ids")).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    both = bpe.round_trip(df.withColumnRenamed("ids", "other"), ranks, pattern, ("doc_id", "text"))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "") for r in both.collect())
    assert bpe.encode(df.limit(0), ranks, pattern).count() == 0


def test_runs_contract_as_single_pairs_do(library):
    encoder = bpe._Encoder(*bpe_files())
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdé -=1") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    kept, bpe.LONG_WORD = bpe.LONG_WORD, 0
    try:
        got = encoder.encode(words)
    finally:
        bpe.LONG_WORD = kept
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(w) for w in words]


def test_unknown_ids_are_an_error(frame):
    df = frame([(1, np.array([4_000_000], "<u4").tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(df, bpe_files()[0]).collect()
