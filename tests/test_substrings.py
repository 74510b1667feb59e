"""The substring search: needles of all lengths, borders of pieces, and what it exchanges."""

import random

from pyspark.sql import functions as F

from veilframe.operators import substrings


def test_needles_of_all_lengths_in_scopes_and_over_borders(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 37)
    rng = random.Random(3)
    texts = [(i, rng.choice("st"), "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    texts += [(60, "s", None), (61, None, "abab"), (62, "s", "")]
    needles = [(s, "".join(rng.choice("abé😀") for _ in range(n))) for s in "st" for n in range(1, 24)]
    needles += [(s, t[k:k + n]) for _, s, t in texts[:40] for k, n in ((0, 5), (7, 9), (11, 20), (3, 60))]
    needles += [(None, "ab"), ("s", None), ("s", "")]
    got = {tuple(r) for r in substrings.substring_hits(
        spark.createDataFrame(texts, "doc_id long, session string, text string").repartition(3),
        spark.createDataFrame(needles, "session string, needle string"), ["doc_id"], ["session"]).collect()}
    assert got == {(i, s, n) for i, s, t in texts for z, n in needles if s and z == s and t and n and n in t}


def test_only_ngrams_that_may_be_filed_are_exchanged(spark, monkeypatch):
    """Texts of random digits: nearly all of their n-grams are nobody's, and needles do not meet texts that lack them."""
    given, met = substrings._met, []
    monkeypatch.setattr(substrings, "_met", lambda *a: met.append(given(*a)) or met[-1])
    texts = spark.range(20_000).select("id", F.concat_ws(" ", F.md5(F.col("id").cast("string")),
                                                         F.md5((-F.col("id")).cast("string"))).alias("text"))
    needles = texts.filter("id % 10 = 0").select(F.substring("text", 1, 32).alias("needle"))
    assert substrings.substring_hits(texts, needles, ["id"]).count() == 2000
    assert 2000 <= met[0].count() < 2100
