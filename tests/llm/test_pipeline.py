import random

import corpus_pipeline

from veilframe.llm import secrets
from tests.llm.test_jaccard import brute


def test_stages_equal_brute_force(spark, frame, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    docs = [(i, prose(rng.choice([8, 60, 150]))) for i in range(80)]
    docs += [(100 + i, docs[i][1] + (" more" if i % 2 else "")) for i in range(10)]  # copies
    docs += [(200, prose(20) + " " + item + " " + prose(20)), (201, "12 34"), (202, None), (203, prose(40) + " token=abcd1234efgh " + prose(5))]
    frame([(i, t, "xx", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame([(1, item)], "item_id long, text string", 1).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in docs if i not in (201, 202)]
    least = {key: component for key, _, component in brute(kept)}
    want = {i for i, _ in kept if least[i] == i} - {200}
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = current.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, current, str(tmp_path)).write.parquet(path)
        current = spark.read.parquet(path)
        if at < 4:
            assert current.columns == columns
        if name == "secret_scan":
            texts = {r["doc_id"]: r for r in current.collect()}
            assert "[SECRET]" in texts[203]["text"] and texts[203]["n_chars"] == len(texts[203]["text"])
            assert all(r["text"] == secrets.masked(dict(docs)[i]) for i, r in texts.items())
    assert {r["doc_id"] for r in current.collect()} == want and current.where("NOT round_trip").count() == 0


def test_clashing_names_repeated_rows_and_an_empty_table(spark, frame, tmp_path):
    """Columns named like anything that a stage makes, a repeated row, a very long text, and no rows at all."""
    rng = random.Random(3)
    words = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    extra = ["lang_pred", "score", "known", "held", "node", "component_id", "__mark", "t", "k0", "sha256", "going", "column_0"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{e}` string" for e in extra)
    long_text = prose(60_000)
    rows = [(i, t, "xx", "s", len(t or ""), *extra) for i, t in enumerate([prose(60), prose(80), None, "", long_text])]
    rows += [rows[0], (9, long_text + " end", "xx", "s", 0, *extra)]
    columns = frame(rows, schema).columns
    frame([(1, prose(30))], "item_id long, text string", 1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, given in (("full", rows), ("none", [])):
        current = frame(given, schema)
        for at, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{stage_name}"
            stage(spark, current, str(tmp_path)).write.parquet(path)
            current = spark.read.parquet(path)
            assert at == 4 or current.columns == columns
        assert sorted(r["doc_id"] for r in current.collect()) == ([0, 1, 4] if given else [])
