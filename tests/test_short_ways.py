"""Work that texts without matches, and words that stand plainly, do not need: same results, less done for each row."""

import re

from pyspark.sql import functions as F

from veilframe.operators.entities import place_entities
from veilframe.operators.redact import redact_fallback, sequential_counter
from veilframe.rules.local import COUNTER_STAGES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_looks_for_the_token_and_not_for_places(spark):
    token = "Zx9Kq2Lm8Wv4Rt7Pb3Nd"
    rows = [(1, f"first {token} then {token}"), (2, "aaaaaaaaaaaaaaaaaaaa1 " + token), (3, None), (4, "plain words")]
    made = redact_fallback(spark.createDataFrame(rows, "doc_id int, text string"), "text").select("doc_id", "sanitized")
    assert {r.doc_id: r.sanitized for r in made.collect()} == {
        1: f"first [HIGH_ENTROPY_REDACTED] then {token}", 2: "aaaaaaaaaaaaaaaaaaaa1 [HIGH_ENTROPY_REDACTED]", 3: "", 4: "plain words"}
    assert "zip_with(" not in plan_of(made)


def test_counter_leaves_texts_alone_at_stages_that_match_nothing(spark):
    rows = [(1, "SSN 123-45-6789 and a@b.com, c@d.org"), (2, "nothing"), (3, None)]
    made = sequential_counter(spark.createDataFrame(rows, "doc_id int, text string"), "text", COUNTER_STAGES)
    assert {r.doc_id: (r.sanitized, r.n_items, [i.original for i in r.items]) for r in made.collect()} == {
        1: ("SSN [SSN_REDACTED_1] and [EMAIL_REDACTED_2], [EMAIL_REDACTED_3]", 3, ["123-45-6789", "a@b.com", "c@d.org"]),
        2: ("nothing", 0, []), 3: ("", 0, [])}
    assert re.search(r"size\(_found#\d+[^)]*\) > 0", plan_of(made))


def test_places_of_entities_with_odd_words(spark):
    cases = [
        ("Ann  Lee and AnnLee, Ann Lee", [["Ann", "Lee"], ["Ann", "Lee"], ["Ann", "Lee"]]),
        ("Ann x Ann Lee", [["Ann", "Lee"], ["Ann"]]),
        ("a  c a c", [["a", ""], ["", "c"], ["a", " c"]]),
        ("x.y (z) é 𝒳 Ω x.y", [["x.y", "(z)"], ["𝒳", "Ω"], ["x.y"], ["gone"]]),
        ("", [["a"]]), ("\\E a\\E b", [["a\\E", "b"]]), (" a\tb", [[" a", "b"]]),
    ]
    rows = [(i, pos, "PER", words, "".join(words), 1.0) for i, (_, named) in enumerate(cases) for pos, words in enumerate(named)]
    entities = spark.createDataFrame(rows, "doc_id int, first_pos int, type string, words array<string>, text string, confidence double")
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    expected = {}
    for i, (text, named) in enumerate(cases):
        at = 0
        for pos, words in enumerate(named):
            hit = re.compile(r"\s*".join(map(re.escape, words)), re.ASCII).search(text, at)
            if hit:
                at = hit.end()
                expected[i, pos] = hit.span()
                continue
            first = re.compile("(?<![A-Za-z0-9_])" + re.escape(words[0]), re.I | re.ASCII).search(text)
            start = text.index(first.group()) if first else 0
            expected[i, pos] = start, start + len("".join(words))
    placed = place_entities(entities, texts, ["doc_id"])
    assert {(r.doc_id, r.first_pos): (r.start, r.end) for r in placed.collect()} == expected
    assert plan_of(placed).count("regexp_substr(") + plan_of(placed).count("RegExpSubStr") < 6
