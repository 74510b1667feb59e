"""Work that is done once for a row: entropies, places of tokens, cuts."""

import re

from suite import detect  # noqa: F401
from suite.registry import QUERIES
from veilframe.operators.knowledge import knowledge_matches
from veilframe.operators.spans import _matches
from veilframe.rules import GATEWAY_RULES
from veilframe.rules.model import add_view, listed_classes

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_three_thresholds_share_one_entropy(spark):
    """each threshold worked the entropy of a token out for itself."""
    assert len(re.findall(r"\baggregate\(", optimized(QUERIES["f2_high_entropy"](spark, SF)))) == 1


def test_texts_meet_a_knowledge_list_once(spark):
    """places were looked for in a second reading, joined with the tokens of the first."""
    docs = spark.createDataFrame([(1, "alpha beta, alpha"), (2, "gamma"), (3, None)], "doc_id long, text string")
    listed = spark.createDataFrame([("alpha", "A"), ("gamma", "G")], "token string, label string")
    found = knowledge_matches(docs, listed, ["doc_id"])
    assert optimized(found).count("Join ") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5, "alpha", "A"), (1, 12, 17, "alpha", "A"), (2, 0, 5, "gamma", "G")]


def test_texts_are_cut_only_where_a_rule_matches(spark):
    """F8 to F16: gaps and groups of a text were looked for wherever a rule's gate was open."""
    rule = GATEWAY_RULES[0]
    df, view, _ = add_view(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "text", (rule,))
    plan = optimized(df.select(_matches(view, rule, 0).alias("m")))
    assert plan.count("split(") == 1 and plan.index("size(") < plan.index("split(")


def test_classes_are_written_out_with_the_same_meaning():
    chars = "".join(map(chr, range(128)))
    for pattern in (r"[\w.\-]", r"[A-Z0-9._%+-]", r"[^@\s]", r"[a-zA-Z0-9_\-\.]", r"[\s,\d.\-]", r"\[[A-Z_]", r"(?i)[a-k\d]"):
        assert re.findall(pattern, chars, re.A) == re.findall(listed_classes(pattern), chars, re.A)
    assert len(listed_classes(r"[\w.\-]{3,}")) > len(listed_classes(r"[\w.\-]"))
