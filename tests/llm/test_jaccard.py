import random
import re

import numpy as np
import pytest

from veilframe.llm import jaccard


def brute(rows, k=5, percent=80):
    """(n, component) by comparing all pairs."""
    sets = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows))


def rows(n=260):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    stock = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 30, 60, 200]))] for _ in range(40)]
    passage = [f"{rng.choice(words)}{i}" for i in range(40)]
    made = []
    for i in range(n):
        text = list(rng.choice(stock))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        made.append((i, " ".join(text + passage if rng.random() < 0.4 else text)))
    return made + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (906, "A  b\nc d"), (907, "É b c d"), (908, "é b c d")]


@pytest.mark.parametrize("split, rounds", [(4, ((0, 1, 2),)), (0, ((0,), (1,)))])
def test_components_equal_brute_force(frame, monkeypatch, split, rounds):
    for name, value in (("OFTEN", 4), ("SPLIT", split), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    given = rows()
    got = jaccard.components_of(frame([(*r, 1) for r in given], "doc_id long, text string, n long"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(given)


def test_one_of_each_group_stays(frame):
    given = rows(60) + [(3, dict(rows(60))[3])] * 2
    left = jaccard.one_of_each(frame(given)).collect()
    assert sorted(r["doc_id"] for r in left) == sorted({c for _, _, c in brute(given)})


def test_empty_table_and_null_keys(frame):
    df = frame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    assert {r["component_id"] for r in jaccard.components_of(df).collect()} == {2}
    assert jaccard.components_of(df.limit(0)).count() == 0


def test_postings_of_frequent_shingles_are_dealt_out():
    rank, node = np.meshgrid(np.arange(200, dtype=np.uint64), np.arange(1, 51, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for keys, nodes in ((rank.ravel(), node.ravel()), (np.zeros(10_000, np.uint64), np.arange(10_000, dtype=np.uint64))):
        batch = jaccard._dealt(keys + np.uint64(1 << 63), nodes)
        held = [len(x) // 8 for x in batch.column("keys").to_pylist()]
        assert sum(held) == 10_000 and max(held) < 100


def test_pairs_of_one_class_are_dealt_out(frame):
    pairs = frame([(1, b) for b in range(2, 2002)], "a long, b long")
    at = [(r["node"], x["a"], x["part"]) for r in jaccard._nodes_with_partners(pairs).collect() for x in r["ats"]]
    parts = {}
    for node, a, part in at:
        parts.setdefault((a, part), []).append(node)
    assert len(at) == 2000 + len(parts) and all(1 in nodes for nodes in parts.values())
    assert max(map(len, parts.values())) < 2 * jaccard.PARTNERS


def test_a_hot_group_with_small_parts_equals_brute_force(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    rng = random.Random(5)
    stock = [f"s{i}" for i in range(80)]
    given = []
    for i in range(120):
        text = list(stock)
        for _ in range(rng.choice([0, 1, 1, 6])):
            text[rng.randrange(80)] = f"x{i}"
        given.append((i, " ".join(text)))
    got = jaccard.components_of(frame(given))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(given)


def pairs_of(df, percent=80):
    """The pairs that lists make where every class is a component of its own, and those whose fronts fit."""
    posted = jaccard.written(jaccard.posted(df, jaccard.frequent_keys(df, "text", 5, percent), "doc_id", "text", 5, percent), "posted")
    lists = jaccard.written(jaccard.posting_lists(posted), "lists")
    pairs = jaccard.written(jaccard.pairs_across(lists.selectExpr("*", "node AS root"), posted, percent), "pairs")
    near = jaccard._compared(jaccard.fronts_of(jaccard._nodes_with_partners(pairs), posted), "front", jaccard._front, jaccard._fronts_fit, percent)
    return posted, pairs, near


@pytest.mark.parametrize("n", [300, 1200])
def test_texts_of_one_common_line_and_own_words_make_no_pairs(frame, n):
    line = "the quick brown fox jumps over the lazy dog and runs away"
    df = frame([(i, f"{line} a{i} b{i}") for i in range(n)])
    _, pairs, near = pairs_of(df)
    assert pairs.count() == 0 and near.count() == 0
    assert {(r["n_shingles"], r["component_id"] == r["doc_id"]) for r in jaccard.components_of(df).collect()} == {(10, True)}


@pytest.mark.parametrize("percent, split", [(80, 0), (80, 4), (100, 0), (33, 0), (55, 1e9)])
def test_pairs_hold_all_links(frame, monkeypatch, percent, split):
    monkeypatch.setattr(jaccard, "OFTEN", 4)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    given = rows(150)
    posted, pairs, near = pairs_of(frame(given), percent)
    node = {r["doc_id"]: r["node"] for r in posted.collect()}
    made = {frozenset((r["a"], r["b"])) for r in pairs.collect()}
    fit = {frozenset((r["a"], r["b"])) for r in near.collect()}
    sets = {}
    for key, text in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    links = {frozenset((node[i], node[j])) for i, a in sets.items() for j, b in sets.items()
             if i < j and a and b and node[i] != node[j] and 100 * len(a & b) >= percent * len(a | b)}
    assert links <= fit <= made


def test_fronts_that_cannot_reach_the_similarity_are_told():
    front = lambda n, *prefixes: (n, [np.array(sorted(x), np.uint32) for x in prefixes])
    one = front(10, [1, 2, 3], [1, 2, 3], [1, 2, 3])
    assert jaccard._fronts_fit(one, one, 80)
    assert not jaccard._fronts_fit(one, front(10, [1, 2, 3], [4, 5, 6], [1, 2, 3]), 80)  # nothing in common under one order
    assert not jaccard._fronts_fit(one, front(10, [1, 7, 8], [1, 2, 3], [1, 2, 3]), 80)  # 1 + 7 of the 9 that a link needs
    assert not jaccard._fronts_fit(one, front(13, [1, 2, 3], [1, 2, 3], [1, 2, 3]), 80)  # sizes


def near_copies(n, seed=7):
    """Texts of one stock with up to eight words of their own: near copies, many of which do not link."""
    rng = random.Random(seed)
    stock = [f"s{i}" for i in range(150)]
    given = []
    for i in range(n):
        text = list(stock)
        for j in range(rng.randrange(9)):
            text[rng.randrange(150)] = f"x{i}_{j}"
        given.append((i, " ".join(text)))
    return given


def test_all_shingles_of_near_copies_are_known_as_frequent(frame):
    assert len(jaccard.frequent_keys(frame(near_copies(200)), "text", 5, 80)) == 146


def test_near_copies_that_do_not_link_make_few_pairs(frame):
    given = near_copies(200)
    _, pairs, near = pairs_of(frame(given))
    sets = sorted({jaccard.shingle_sets([x])[0].tobytes() for _, x in given})
    sets = [np.frombuffer(x, np.uint64) for x in sets]
    links = sum(jaccard._sets_link(a, b, 80) for i, a in enumerate(sets) for b in sets[:i])
    assert links <= near.count() <= pairs.count() <= 1.5 * links
    got = jaccard.components_of(frame(given))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(given)


def test_signs_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 50, 300, 3000)]
    marks = jaccard.signs(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for a, x in zip(sets, marks):
        for b, y in zip(sets, marks):
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
