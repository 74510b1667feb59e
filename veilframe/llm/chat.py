"""Chat formatting: records of any known layout to canonical turns, and turns to training text.

A record is a JSON object. The names of its nested fields, as sorted paths, are hashed to a
fingerprint; a fingerprint selects the declarative mapping whose fields the record has. Mappings
turn message lists, prompt and response pairs and instruction records into turns of a role and
a text. Turns are written by a template whose control strings are escaped inside texts, in a way
that is undone exactly; a mask marks the characters that a model is trained on.

Records are mapped where they are. Turns stay rows of their own, so that no conversation has to fit
in memory; digests of whole conversations are made as their sorted turns stream by.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veilframe.llm.common import map_texts

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
#: Turns of a conversation that make one record.
FRAGMENT = 16


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    `each` is the path of a list with a turn for each item, whose role and text are at `role` and
    `text` in it; or `fields` are (role, paths) for a turn each, joined by blank lines; a path
    that ends in ? may be missing. `needs` are the paths that the layout is known by.
    """

    name: str
    needs: frozenset[str]
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


def _mapping(name: str, needs: str, **how) -> Mapping:
    return Mapping(name, frozenset(needs.split()), **how)


HUMAN = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant", "prompter": "user", "Human": "user", "Assistant": "assistant", "User": "user"}
#: Tried in this order; the first whose fields are all there is taken.
MAPPINGS = (
    _mapping("authored", "messages[].author.role messages[].content.parts[]", each="messages", role="author.role", text="content.parts"),
    _mapping("parts", "messages[].role messages[].content[].text", each="messages", role="role", text="content.text"),
    _mapping("messages", "messages[].role messages[].content", each="messages", role="role", text="content"),
    _mapping("from_value", "conversations[].from conversations[].value", each="conversations", role="from", text="value", roles=HUMAN),
    _mapping("dialogue", "dialogue[].speaker dialogue[].utterance", each="dialogue", role="speaker", text="utterance", roles=HUMAN),
    _mapping("instruction", "instruction output", fields=(("system", ("system?",)), ("user", ("instruction", "input?")), ("assistant", ("output",)))),
    _mapping("prompt_response", "prompt response", fields=(("system", ("system?",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    _mapping("prompt_completion", "prompt completion", fields=(("system", ("system?",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    _mapping("question_answer", "question answer", fields=(("system", ("system?",)), ("user", ("context?", "question")), ("assistant", ("answer",)))),
    _mapping("turn", "role content", fields=()),
)


def paths_of(value, prefix: str = "") -> set[str]:
    """The paths of all fields; items of lists share theirs."""
    found, work = set(), [(value, prefix)]
    while work:
        one, at = work.pop()
        if isinstance(one, dict):
            work += [(v, f"{at}.{k}" if at else k) for k, v in one.items()]
        elif isinstance(one, list):
            found.add(f"{at}[]")
            work += [(v, f"{at}[]") for v in one]
        if at:
            found.add(at)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _said(value) -> str:
    """The text of a value: strings as they are, parts one after the other."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_said(v.get("text") if isinstance(v, dict) and "text" in v else v) for v in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _at(value, path: str):
    for name in path.split("."):
        if isinstance(value, list):
            value = [v.get(name) if isinstance(v, dict) else v for v in value]
        elif isinstance(value, dict):
            value = value.get(name)
        else:
            return None
    return value


def turns_of(record: dict, mapping: Mapping) -> list[dict]:
    if mapping.name == "turn":
        return [{"role": _said(record["role"]), "text": _said(record["content"])}]
    if mapping.each:
        items = record[mapping.each]
        roles = [_said(_at(x, mapping.role)) for x in items]
        return [{"role": mapping.roles.get(r, r), "text": _said(_at(x, mapping.text))} for r, x in zip(roles, items)]
    turns = []
    for role, paths in mapping.fields:
        there = [p.rstrip("?") for p in paths if not p.endswith("?") or record.get(p.rstrip("?"))]
        if there:
            turns.append({"role": role, "text": "\n\n".join(_said(_at(record, p)) for p in there)})
    return turns


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def canonical(df: DataFrame, keys: tuple[str, ...], record: str = "record") -> DataFrame:
    """The keys, `fingerprint`, `layout` and `turns` of each record.

    A null, broken or unknown record has no layout and null turns; its fingerprint (null if it is not
    a JSON object) tells which mapping is missing. A record with an empty list has no turns.
    Null roles and texts count as empty. Other columns are ignored.
    """
    fields = [T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", T.ArrayType(TURN))]
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def make():
        known: dict[str, Mapping | None] = {}

        def one(raw: str | None) -> tuple:
            try:
                value = json.loads(raw or "")
            except (ValueError, RecursionError):
                return None, None, None
            if not isinstance(value, dict):
                return None, None, None
            paths = paths_of(value)
            mark = fingerprint(paths)
            if mark not in known:
                if len(known) > 100_000:
                    known.clear()
                known[mark] = next((m for m in MAPPINGS if m.needs <= paths), None)
            mapping = known[mark]
            if mapping is None:
                lists = [m for m in MAPPINGS if m.each and value.get(m.each) == []]
                return mark, lists[0].name if lists else None, [] if lists else None
            return mark, mapping.name, turns_of(value, mapping)

        def work(records: list) -> list[pa.Array]:
            made = [one(r) for r in records]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], arrow)]

        return work

    return map_texts(df, keys, record, fields, make)


def escaped(text: Column) -> Column:
    """The text without control strings: a backslash goes before the second character of each."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (BEGIN, HEAD, BODY, END):
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """The turns with `segment`, the text that the template makes of each, and its mask.

    `mask_start` and `mask_end` are the characters of the segment that a model is trained on, equal
    for turns of other roles. A conversation's text is its segments one after the other.
    """
    said, name = escaped(F.coalesce(F.col(text), F.lit(""))), escaped(F.coalesce(F.col(role), F.lit("")))
    head = F.concat(F.lit(BEGIN + HEAD), name, F.lit(BODY))
    trained = F.coalesce(F.col(role) == TRAINED, F.lit(False))
    with_segment = turns.withColumn("segment", F.concat(head, said, F.lit(END))).withColumn("mask_start", F.length(head))
    return with_segment.withColumn("mask_end", F.when(trained, F.length("segment") - len(END)).otherwise(F.col("mask_start")))


def read_back(segments: DataFrame) -> DataFrame:
    """The segments with `role`, `text` and `loss_text` as they are read from the formatted text and mask."""
    pattern = r"(?s)\A<s>\[INST\](.*?)\[/INST\](.*)</s>\z"
    masked = F.substring("segment", F.col("mask_start") + 1, F.col("mask_end") - F.col("mask_start"))
    return segments.select("*", unescaped(F.regexp_extract("segment", pattern, 1)).alias("role"),
                           unescaped(F.regexp_extract("segment", pattern, 2)).alias("text"), unescaped(masked).alias("loss_text"))


def digests(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For each conversation what is asked of its turns as a whole, from their sorted stream."""
    kind = turns.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done = []
            for conv, role, text, loss, size in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text", "loss_text", "size"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += size
            yield _finished(done, batch.schema.field("key").type, schema.names)
        if state is not None:
            yield _finished([state], batch.schema.field("key").type, schema.names)

    picked = turns.select(F.col(key).alias("key"), *order, "role", "text", "loss_text", F.length("segment").alias("size"))
    ordered = picked.repartition("key").sortWithinPartitions("key", *order)
    return ordered.drop(*order).mapInArrow(run, schema)


def _finished(states: list, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = [[s[0] for s in states], [s[1] for s in states], [s[2].hexdigest() for s in states], [s[3] for s in states], [s[4].hexdigest() for s in states], [s[5] for s in states]]
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def records_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, part, record) from rows by turn: fragments of FRAGMENT turns in the layouts that sources use.

    Turns are ordered by number, then role and text. A fragment of a prompt and a reply, or of an
    instruction with a system text before it, has the layout of such; others have one of the
    list layouts, by a hash of the conversation, where it can tell the roles.
    """
    rows = turns.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text")) - 1
    rows = rows.withColumn("place", place).withColumn("part", F.floor(F.col("place") / FRAGMENT))
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    said = lambda i: F.col("t")[i]["text"]
    listed = lambda make: F.transform("t", make)
    plain = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    human = lambda x: F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("gpt")).otherwise(x["role"])
    layouts = {
        "authored": F.to_json(F.struct(listed(lambda x: F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content"))).alias("messages"))),
        "parts": F.to_json(F.struct(listed(lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages"))),
        "messages": F.to_json(F.struct(listed(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))),
        "from_value": F.to_json(F.struct(listed(lambda x: F.struct(human(x).alias("from"), x["text"].alias("value"))).alias("conversations"))),
        "prompt_response": F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response"))),
        "instruction": F.to_json(F.struct(said(0).alias("system"), said(1).alias("instruction"), said(2).alias("output"))),
    }
    choice = F.pmod(F.xxhash64("key", "part"), F.lit(4))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), layouts["prompt_response"])
        .when((roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))) & (said(0) != ""), layouts["instruction"])
        .when((choice == 0) & plain, layouts["from_value"]).when(choice == 1, layouts["authored"]).when(choice == 2, layouts["parts"]).otherwise(layouts["messages"])
    )
    return parts.select(F.col("key").alias(key), "part", record.alias("record"))


def turns_table(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, part, place, role, text) of canonical records."""
    return records.select(key, "part", F.posexplode("turns").alias("place", "turn")).select(key, "part", "place", "turn.role", "turn.text")
