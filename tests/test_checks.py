"""A choice of the registered queries against their SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
CHOSEN = ("p1_client_spans", "p2_entity_spans", "w1_leftmost", "w2_longest_first", "c1_client_pipeline",
          "c2_gateway_pipeline", "r3_session_redaction", "c6_conversation_decision",
          "c6_audit_records", "a7_type_shares", "w5_reading_order", "w6_tag_groups",
          "t3_running_counters", "t5_reply_stream")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(n) for n in names]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_every_query_has_a_check():
    own = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
