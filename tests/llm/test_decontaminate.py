import random

import numpy as np

from veilframe.llm import decontaminate

RNG = random.Random(11)
COMMON = "the of and to in is that it was for".split()


def prose(n):
    return [RNG.choice(COMMON) if RNG.random() < 0.5 else "".join(RNG.choice("bdfgklmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(n)]


def given():
    items = [(i, " ".join(prose(n)) + ".") for i, n in enumerate([4, 8, 15, 20, 30, 40, 50, 59])] + [(90, None), (91, "")]
    docs, true = [(i, " ".join(prose(RNG.choice([5, 40, 200, 900])))) for i in range(150)], set()
    for i, text in items[1:8]:
        for at in (1000, 1100):  # verbatim, and with every ninth word changed or a word put in
            words = text.split()
            if at == 1100:
                words = [w if j % 9 != 4 else "changed" for j, w in enumerate(words)] if len(words) > 12 else words
                words.insert(len(words) // 2, "inserted")
            docs.append((at + i, " ".join(prose(RNG.choice([0, 30, 300])) + words + prose(100))))
            true.add((at + i, i))
    return items, docs + [(2000, None), (2001, "")], true


def test_planted_items_are_found_and_others_left(frame):
    items, docs, true = given()
    df, bench = frame(docs), frame(items, "item_id long, text string", 2)
    index = decontaminate.build(bench, df)
    assert {(r["doc_id"], r["item"]) for r in decontaminate.leaks(df, index).collect()} == true
    extra = frame([(*d, "x") for d in docs], "doc_id long, text string, held string")
    left = decontaminate.clean(extra.withColumnRenamed("held", "more"), index)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in true} and left.columns == ["doc_id", "text", "more"]


def test_latent_candidates_against_brute_force(frame):
    """Windows whose plain TF-IDF cosine to a passage is high are candidates in the latent space too."""
    items, docs, _ = given()
    df, bench = frame(docs), frame(items, "item_id long, text string", 2)
    index = decontaminate.build(bench, df)
    searcher = decontaminate._Searcher(index, index.blocks[0])
    near = found = 0
    for _, text in docs:
        words = decontaminate.hashed(text)
        if not len(words):
            continue
        got = {(start, item) for _, start, _, item, _ in searcher.candidates(words, np.array([0, len(words)]), 0)}
        for start in decontaminate.window_starts(len(words), 16, 8).tolist():
            a, x = decontaminate._weighted(words[start:start + 16].tobytes(), index.weights)
            for at, (_, own, _) in enumerate(index.blocks[0]["items"]):
                if len(own) < 12:
                    continue
                for s in decontaminate.window_starts(len(own), 16, 8).tolist():
                    b, y = decontaminate._weighted(own[s:s + 16].tobytes(), index.weights)
                    _, i, j = np.intersect1d(a, b, return_indices=True)
                    if float(x[i] @ y[j]) >= 0.7:
                        near += 1
                        found += (start, at) in got
    assert near > 20 and found >= 0.9 * near


def test_common_subsequence():
    pattern = decontaminate.Pattern(np.array([1, 2, 3, 2, 5], np.uint64))
    assert pattern.common([9, 1, 2, 8, 2, 5]) == 4 and pattern.common([]) == 0 and pattern.common([5, 2, 3]) == 2


def test_empty_tables(frame):
    items, docs, _ = given()
    df, bench = frame(docs), frame(items, "item_id long, text string", 2)
    assert decontaminate.leaks(df, decontaminate.build(bench.limit(0), df)).count() == 0
    assert decontaminate.leaks(df.limit(0), decontaminate.build(bench, df.limit(0))).count() == 0


def test_a_task_gets_only_its_own_block(frame, monkeypatch):
    """What is sent with the search of one block does not grow with the number of blocks."""
    import numpy as np
    from pyspark import cloudpickle
    from pyspark.sql import types as T

    sent = []
    monkeypatch.setattr(decontaminate, "map_texts", lambda docs, keys, text, fields, make, **more: sent.append(len(cloudpickle.dumps(make))))
    block = {"items": [], "passages": {0: [(np.zeros(50_000), 0)]}}
    for n in (1, 6):
        index = decontaminate.Index(np.zeros(9), np.zeros(9), np.zeros((9, 4)), [block] * n, T.LongType())
        decontaminate._searched(None, index, dict(block), ("doc_id",), "text", T.StructType())
    assert sent[0] == sent[1]
