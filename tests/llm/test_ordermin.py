import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import ordermin


def brute_signature(text, k=ordermin.K):
    """Every k-mer with its occurrence number, ranked under every function, one by one."""
    hashes = [int(h) for h in ordermin.items(text, k)]
    parts = []
    for factor in map(int, ordermin._FACTORS):
        ranked = sorted(range(len(hashes)), key=lambda i: ((hashes[i] >> 32) * factor % 2**32, hashes[i] % 2**32, i))
        chosen = sorted(ranked[:ordermin.TUPLE])
        made = np.array([len(chosen)], np.uint64)
        for i in chosen:
            made = ordermin._mixed(made * ordermin._PRIME + np.uint64(hashes[i]))
        parts.append(f"{int(made[0] >> np.uint64(32)):08x}")
    return "".join(parts)


def words(seed, n):
    choose = random.Random(seed)
    return " ".join(choose.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(choose.randrange(50)) for _ in range(n))


TEXTS = ["", "a", "abcd", "abcde", "aaaaaaaaaaaaaaa", "ab" * 40, words(1, 60), words(2, 400), "é漢😀" * 30, words(3, 1500)]


@pytest.mark.parametrize("text", TEXTS)
def test_signature_equals_brute_force(text):
    assert ordermin.signature(text).tobytes().hex() == brute_signature(text)


def test_occurrence_numbers_tell_repeats_apart():
    assert len(set(ordermin.items("aaaaaaaa").tolist())) == 4
    assert ordermin.items("abcdeXabcde")[0] != ordermin.items("abcdeXabcde")[6]
    assert ordermin.items("abcdeX")[0] == ordermin.items("abcdeY")[0]


def test_order_counts():
    """A text of swapped halves keeps nearly all k-mers, but not their order."""
    one, two = words(4, 300), words(5, 300)
    same = lambda a, b: float(np.mean(ordermin.signature(a) == ordermin.signature(b)))
    swapped, few_edits = same(f"{one} {two}", f"{two} {one}"), same(f"{one} {two}", f"{one} x {two}")
    assert few_edits > 0.9 and 0.3 < swapped < 0.75


def test_long_text_is_hashed_whole():
    text = words(6, 200_000)  # over 2^20 items
    assert len(ordermin.items(text)) > 1 << 20
    changed = text[:-30_000] + words(7, 5_000)
    assert 0.9 < float(np.mean(ordermin.signature(text) == ordermin.signature(changed))) < 1


def expected(rows):
    out = {}
    for i, (key, text) in enumerate(rows):
        own, follower = text or "", rows[(i + 1) % len(rows)][1] or ""
        changed = ordermin.edited(own, follower)
        prints = [brute_signature(t) for t in (own, changed, follower)]
        near = [sum(prints[0][j:j + 8] == p[j:j + 8] for j in range(0, len(p), 8)) / ordermin.SIZE for p in prints[1:]]
        out[key] = (len(own), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1], *near)
    return out


def test_edit_likeness_equals_brute_force(frame):
    rows = [(i * 7 - 20, t) for i, t in enumerate([*TEXTS, None, "", words(6, 50), words(6, 50)])]
    shuffled = random.Random(1).sample(rows, len(rows))
    got = {r[0]: tuple(r[1:]) for r in ordermin.edit_likeness(frame(shuffled, parts=5)).collect()}
    assert got == expected(sorted(rows))


def test_odd_tables(frame):
    assert ordermin.edit_likeness(frame([])).count() == 0
    alone = ordermin.edit_likeness(frame([(1, "a lone text of some words")])).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 25
    # null and repeated keys, and columns named like results
    rows = [(None, "first text here", "x"), (3, "second text here", "x"), (3, "second text here", "x"), (3, None, "x")]
    got = ordermin.edit_likeness(frame(rows, "doc_id long, text string, fingerprint string"), "doc_id").orderBy("doc_id", "n_chars").collect()
    assert [(r["doc_id"], r["n_chars"]) for r in got] == [(None, 15), (3, 0), (3, 16), (3, 16)]
    assert got[2]["fingerprint"] == got[3]["fingerprint"]
    with pytest.raises(ValueError):
        ordermin.fingerprints(frame(rows, "doc_id long, text string, fingerprint string"), ("fingerprint",))


def test_fingerprints_and_likeness(frame):
    made = ordermin.fingerprints(frame([(1, "some words to begin"), (2, "some words to begin"), (3, None)]))
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[3]["n_chars"] == 0
    a, b = (made.where(f"doc_id = {i}").select(F.col("fingerprint").alias(n)) for i, n in ((1, "a"), (3, "b")))
    pair = a.crossJoin(b).select(ordermin.likeness(F.col("a"), F.col("a")), ordermin.likeness(F.col("a"), F.col("b"))).first()
    assert tuple(pair) == (1.0, 0.0)
