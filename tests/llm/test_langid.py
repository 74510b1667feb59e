import itertools
import random

import numpy as np

from veilframe.llm import langid
from veilframe.llm.common import most_frequent

RNG = random.Random(2)
STOCK = {"xx": "bana lomi keru tano sivu".split(), "yy": "grot plask dren fulk wist".split(), "ру": "дом лес река поле небо".split()}


def said(lang, n):
    return " ".join(RNG.choice(STOCK[lang]) + RNG.choice(["", "a", "o"]) for _ in range(n))


def labelled():
    return [(i, said(lang, 60), lang) for i, lang in enumerate(RNG.choice(sorted(STOCK)) for _ in range(90))]


def test_held_out_accuracy_and_spans(frame):
    rows = labelled()
    model = langid.fit(frame(rows[:60] + [(900, None, "xx"), (901, "word", None)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(STOCK)
    mixed = said("xx", 30) + ". " + said("yy", 30)
    extra = [(500, None, "zz"), (501, "", "zz"), (502, "123 -- ²", "zz"), (503, mixed, "zz"), (504, "река", "zz"), (505, said("xx", 40_000), "zz"), (505, "bana", "zz")]
    df = frame(rows[60:] + extra, "doc_id long, text string, lang string").selectExpr("*", "lang AS lang_pred", "1 AS score")
    got = {(r["doc_id"], r["lang_spans"][0]["end"] if r["lang_spans"] else 0): r for r in langid.identify(df, model).collect()}
    by = {k: r for (k, _), r in got.items()}
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang in rows[60:]]) >= 0.95
    assert [by[i]["lang_pred"] for i in (500, 501, 502, 504)] == ["und", "und", "und", "ру"]
    spans = by[503]["lang_spans"]
    assert [s["lang"] for s in spans] == ["xx", "yy"] and abs(spans[1]["start"] - len(mixed) // 2) < 40
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_no_labels_know_no_language(frame):
    df = frame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert [r["lang_pred"] for r in langid.identify(df, model).collect()] == ["und"]
    assert langid.identify(df.limit(0), model).count() == 0


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, size = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        scores = -rng.random((n, size)) * 4
        worth = lambda path: sum(scores[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(worth, itertools.product(range(size), repeat=n)))
        assert abs(worth(langid.viterbi(scores, 1.5).tolist()) - best) < 1e-9


def test_unknown_language_has_little_known(frame):
    model = langid.fit(frame(labelled(), "doc_id long, text string, lang string"))
    made = "qzoxj wyvhu jhqcc uxqyz"
    texts = [(1, said("xx", 60), ""), (2, " ".join(RNG.choice(made.split()) for _ in range(60)), ""), (3, "ελληνικά γράμματα εδώ", "")]
    got = {r["doc_id"]: r["known"] for r in langid.identify(frame(texts, "doc_id long, text string, lang string"), model).collect()}
    assert got[1] > 0.95 and got[2] < 0.3 and got[3] < 0.3


def test_equal_counts_fill_the_list(frame):
    """Frequent keys come first, and equal counts fill what is left, the same ones each time."""
    rows = [(i, 1) for i in range(95)] + [(1000 + i, 9) for i in range(5)]
    counts = frame(rows, "key long, n long")
    for size, least in ((40, 9), (3, 9), (5, 9), (100, 1), (500, 1)):
        got = [r["key"] for r in most_frequent(counts, size).collect()]
        assert len(got) == len(set(got)) == min(size, 100)
        assert len(set(got) & set(range(1000, 1005))) == min(size, 5)
        assert sorted(got) == sorted(r["key"] for r in most_frequent(counts.repartition(7), size).collect())
    assert most_frequent(counts.limit(0), 4).count() == 0
