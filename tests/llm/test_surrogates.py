import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import surrogates

ROWS = [
    (1, "Call +1 (743) 555-3824 or 743-555-3824, mail Ann.Lee@Mail.co.uk / ann.lee@mail.co.uk"),
    (2, "Mrs. Anna Schmidt met Dr Anna Schmidt and Herr Schmidt. г-н Иван Петров, श्री राम कुमार."),
    (3, "card 4532 0159 8741 2365 and 4532-0159-8741-2365, bad 4532 0159 8741 2360"),
    (4, None), (5, ""), (6, "nothing 12 here 3.14, v1.2.3 2024-01-02 at 10:30, 9807915762804490"),
    (7, "ip 10.0.0.1 and 10.0.0.1, ssn 123-45-6789"), (7, "ip 10.0.0.1 and 10.0.0.1, ssn 123-45-6789"), (None, "x" * 300_000 + " ann.lee@mail.co.uk"),
]


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, canon string").repartition(3)
    return {r["doc_id"]: r for r in surrogates.with_surrogates(df, "secret").collect()}, df


def test_types_formats_and_coreference(made):
    got, _ = made
    phone = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}), mail (\S+) / (\S+)", got[1]["text"])
    assert phone[1] + phone[2] == phone[3] + phone[4] and phone[1] + phone[2] != "743555-3824"
    assert phone[5] == phone[6] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.example\.uk", phone[5])
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Dr (\w+) (\w+) and Herr (\w+)\. г-н ([А-я]+) ([А-я]+), श्री ([\u0900-\u097f]+) ([\u0900-\u097f]+)\.", got[2]["text"])
    assert names[1] == names[3] and names[2] == names[4] == names[5] and names[1].endswith(("a", "ine", "elle"))
    cards = re.fullmatch(r"card (\S+ \S+ \S+ \S+) and (\S+), bad 4532 0159 8741 2360", got[3]["text"])
    assert cards[1].replace(" ", "") == cards[2].replace("-", "") != "4532015987412365" and luhn(cards[2].replace("-", ""))
    ip = re.fullmatch(r"ip (\S+) and (\S+), ssn (9\d\d-\d\d-\d{4})", got[7]["text"])
    assert ip[1] == ip[2] != "10.0.0.1" and all(int(x) < 256 for x in ip[1].split("."))
    assert got[None]["text"].endswith(phone[5])


def test_clean_rows_stay(made):
    got, df = made
    assert [got[i]["text"] for i in (4, 5, 6)] == [None, "", dict(ROWS)[6]] and all(got[i]["n_mentions"] == 0 for i in (4, 5, 6))
    assert df.count() == len(ROWS) and set(got[1].asDict()) == {"doc_id", "text", "canon", "n_mentions"}
    assert surrogates.with_surrogates(df.limit(0), "k").count() == 0


def test_collisions_are_resolved(spark, monkeypatch):
    """With few forms, each entity still gets one of its own, and none is an entity of the data."""
    few = lambda kind, canon, gender, key, attempt: F.pmod(F.xxhash64(canon, attempt), F.lit(160)).cast("string")
    monkeypatch.setattr(surrogates, "surrogate", few)
    entities = spark.range(40).select(F.lit("phone").alias("kind"), F.col("id").cast("string").alias("canon"), F.lit("u").alias("gender"))
    forms = [r["surrogate"] for r in surrogates.resolved(entities, "k").where("canon < '3'").collect()]
    assert len(set(forms)) == len(forms) and not set(forms) & {str(i) for i in range(40)}
