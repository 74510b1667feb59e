"""The leak check exchanges needles, n-grams and texts once each, however many needles there are."""

from pyspark.sql import functions as F

from veilframe.operators import substrings


def test_unique_needles_nulls_and_copies(spark):
    texts = [(1, "s", "aa secret-one bb"), (1, "s", "other secret-two"), (None, "s", "secret-one"), (2, None, "secret-one"),
             (3, "t", "secret-one secret-two"), (4, "s", None), (5, "s", "secret-on")]
    needles = [("s", "secret-one"), ("s", "secret-two"), ("t", "secret-two"), ("s", ""), (None, "secret-one"), ("s", "secret-one")]
    want = {(i, s, n) for i, s, t in texts for c, n in needles if t and n and c and c == s and n in t}
    texts = spark.createDataFrame(texts, "id long, session string, text string")
    needles = spark.createDataFrame(needles, "session string, needle string")
    for unique in (False, True):  # a wrong promise does not change the result
        got = [tuple(r) for r in substrings.substring_hits(texts, needles, ["id"], ["session"], unique=unique).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hits_are_made_distinct_where_they_stand(spark):
    texts = spark.range(400).select("id", F.concat(F.lit("text with secret-"), "id").alias("text"))
    needles = spark.range(400).select(F.concat(F.lit("secret-"), "id").alias("needle"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = substrings.substring_hits(texts, needles, ["id"], unique=True)
        assert hits.count() == sum(str(j) in [str(i)[:k] for k in range(1, 4)] for i in range(400) for j in range(400))
        plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 4, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_originals_alone(spark):
    texts = spark.createDataFrame([(1, "s", "x tok_abcdef y")], "id long, session string, text string")
    tokens = spark.createDataFrame([("s", "tok_abcdef"), ("s", "nowhere")], "session string, original string")
    assert [r.asDict() for r in substrings.find_leaks(texts, tokens, ["id"], ["session"]).collect()] == [
        {"id": 1, "session": "s", "original": "tok_abcdef"}]


def test_many_needles_keep_their_bits():
    assert all(2 ** substrings._table_bits(n) >= 16 * n for n in (10, 10**6, 10**7, 65 * 10**6))
