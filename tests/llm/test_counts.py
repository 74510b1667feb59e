import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from veilframe.llm import counts  # noqa: E402
from veilframe.llm.queries import PIECES  # noqa: E402


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(PIECES))
    own = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return own


def test_counts_are_those_of_the_library(frame, library):
    rng = random.Random(0)
    texts = ["x" * 5000, "the cat sat on the mat", "a\r\nb", "x▁y", "日本" * 300] + ["t" + "".join(rng.choice("abc  éü日本\n\tx👩 the{}\r;") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(9000, None, 5), (9001, "", 5), (None, "the", 5), (3, texts[3], 5)]
    df = frame(rows, "doc_id long, text string, n_tokens long").withColumnRenamed("n_tokens", "score_of_source")
    got = counts.token_counts(df, public.path(PIECES), ("doc_id",)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 9000:
            assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]]).ids)
        elif r["doc_id"] is not None:
            assert (r["n_tokens"], r["score"]) == (0, 0.0)
    assert counts.token_counts(df.limit(0), public.path(PIECES)).count() == 0


def test_parts_add_up_to_the_whole():
    vocabulary = counts.Vocabulary(public.path(PIECES))
    text = " two  blanks\nand lines▁\t" * 5
    assert sum(vocabulary.count(p)[0] for p in vocabulary.parts(text)) == vocabulary.count(counts.MARK + text.replace(" ", counts.MARK))[0]
