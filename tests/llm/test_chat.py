import hashlib
import json

from pyspark.sql import functions as F

from veilframe.llm import chat
from veilframe.llm.queries import op8_chat_format

LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
    "parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "r"}]}]},
    "authored": {"messages": [{"author": {"role": "user"}, "content": {"parts": ["q"]}}, {"author": {"role": "assistant"}, "content": {"parts": ["r"]}}]},
    "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
    "dialogue": {"dialogue": [{"speaker": "User", "utterance": "q"}, {"speaker": "Assistant", "utterance": "r"}]},
    "instruction": {"instruction": "q", "output": "r", "input": ""},
    "prompt_response": {"prompt": "q", "response": "r"},
    "prompt_completion": {"prompt": "q", "completion": "r", "id": 3},
    "question_answer": {"question": "q", "answer": "r"},
}


def test_layouts_become_the_same_turns(frame):
    rows = [(name, json.dumps(value), "x") for name, value in LAYOUTS.items()]
    rows += [("unknown", '{"a": {"b": [1]}}', "x"), ("broken", "{", "x"), ("list", "[1]", "x"), ("null", None, "x"), ("empty", '{"messages": []}', "x")]
    got = {r["name"]: r for r in chat.canonical(frame(rows, "name string, record string, turns string"), ("name",)).collect()}
    for name in LAYOUTS:
        assert got[name]["layout"] == name
        assert [(t["role"], t["text"]) for t in got[name]["turns"]] == [("user", "q"), ("assistant", "r")]
    assert got["unknown"]["layout"] is None and got["unknown"]["turns"] is None and got["unknown"]["fingerprint"]
    assert all(got[n]["fingerprint"] is None for n in ("broken", "list", "null")) and got["empty"]["turns"] == []
    assert len({got[n]["fingerprint"] for n in LAYOUTS}) == len(LAYOUTS)


def test_escapes_are_undone_and_leave_no_control_strings(frame):
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\</s>", "<\\/s>", "<<s>", "[[INST]]", "<s" * 3 + ">", "\n\\\n", "é👩"]
    df = frame([(i, "assistant", t) for i, t in enumerate(texts)], "i long, role string, text string")
    for r in chat.read_back(chat.formatted(df).drop("role", "text")).collect():
        assert (r["role"], r["text"], r["loss_text"]) == ("assistant", texts[r["i"]], texts[r["i"]])
        assert r["segment"].count("<s>") == r["segment"].count("</s>") == r["segment"].count("[INST]") == r["segment"].count("[/INST]") == 1


def test_query_equals_brute_force(spark, frame, tmp_path):
    rows = [(c, t, ["system", "user", "assistant", None, "tool"][(c * t) % 5], f"text {c} {t} </s>" * (t % 4)) for c in range(30) for t in range(1 + c % 7)]
    rows += [(77, t, "user" if t % 2 else "assistant", f"long {t}") for t in range(100)] + [(78, 0, "user", None), (78, 0, "user", None), (79, None, "user", "no number"), (80, 0, "user", "q"), (80, 1, "assistant", "r")]
    frame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    by: dict = {}
    for c, t, role, text in rows + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    got = op8_chat_format(spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
