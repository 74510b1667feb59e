"""The custom validator and its SQL where a card number is the end of a longer secret."""

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def test_card_inside_a_longer_token(spark, tmp_path):
    """Orders whose session token ends in 16 digits that are a valid card (2193598, 5140719, 7338159), and plain cards."""
    orders = spark.createDataFrame([(k, k % 97, "1-URGENT") for k in [2193598, 5140719, 7338159, *range(24, 4000, 40)]],
                                   "o_orderkey long, o_custkey long, o_orderpriority string")
    documents = spark.createDataFrame([(1, "web", "Visa 4111 1111 1111 1111, not 4111 1111 1111 1112"),
                                       (2, "web", "key abc123.-4111111111111111 and 4111111111111111")],
                                      "doc_id long, source string, text string")
    con = duckdb.connect()
    for name, table in (("orders", orders), ("documents", documents)):
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {(r["doc_id"], r["n"]) for r in entry.queries()["u1_custom_validator"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(entry.oracle_sql()["u1_custom_validator"]).fetchall())
    assert {(1, 1), (2, 2)} <= got and 1_007_338_159 not in {k for k, _ in got}  # the other two tokens are of too little entropy
