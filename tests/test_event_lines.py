"""Event lines of long texts."""

import json
import time

from suite.ledger import event_lines


def test_event_lines_take_time_by_the_length_of_a_text(spark):
    long = "ab😀\nd" * 200_000
    texts = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "x" * 22), (5, "y" * 23)], "stream_id long, text string")
    event_lines(texts.filter("stream_id > 1")).collect()
    begin = time.time()
    lines = {}
    for r in event_lines(texts).orderBy("stream_id", "seq").collect():
        assert r["seq"] == len(lines.setdefault(r["stream_id"], []))
        lines[r["stream_id"]].append(r["line"])
    assert time.time() - begin < 20
    assert all(got.pop() == "data: [DONE]" for got in lines.values())
    pieces = {k: [json.loads(line[6:])["choices"][0]["delta"].get("content") for line in got] for k, got in lines.items()}
    assert "".join(pieces[1]) == long and {len(p) for p in pieces[1][:-1]} == {11}
    assert {k: pieces[k] for k in (2, 3, 4, 5)} == {2: [""], 3: [None], 4: ["x" * 11] * 2, 5: ["y" * 11] * 2 + ["y"]}
