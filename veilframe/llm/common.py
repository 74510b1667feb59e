"""What several operators share: batches of texts to Python, a scratch folder, row keys."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.lineage import shared_folder

#: Rows and characters that Python works on at once; a single longer text is a batch of its own.
BATCH_ROWS = 512
BATCH_CHARS = 1 << 20


_HELD: dict[tuple[str, Any], Any] = {}
#: Modules that keep the same things.
_TOGETHER = {"jaccard": "shingles", "decontaminate": "shingles"}


def held(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task for one operator; there is only ever one operator's (see `only_for`)."""
    only_for(operator)
    if (operator, key) not in _HELD:
        _HELD[operator, key] = make()
    return _HELD[operator, key]


def only_for(operator: str) -> None:
    """Let go of what this worker keeps for other operators: workers outlive their stages, and a pipeline has many."""
    operator = _TOGETHER.get(operator, operator)
    stale = [k for k in _HELD if k[0] != operator]
    if not stale:
        return
    for k in stale:
        close = getattr(_HELD.pop(k), "close", None)
        if close is not None:
            close()
    gc.collect()
    _return_memory()


def _return_memory() -> None:
    """What was freed goes back to the machine, where the C library can do that; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work for an operator, before which other operators' things are let go, and after which its memory is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for(operator)
        try:
            yield from run(batches)
        finally:
            _return_memory()

    return whole


def slices(batch: pa.RecordBatch, text: str, rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that no part holds more than `rows` rows or, but for one long text, `chars` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for at, n in enumerate(lengths):
        if at > start and (at - start >= rows or size + n > chars):
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list], Iterable[pa.Array]]],
    kind: str = "string",
    rows: int = BATCH_ROWS,
    chars: int = BATCH_CHARS,
) -> DataFrame:
    """The key columns as they are, and what a function makes of the text of each row.

    `make` is called once in each task and returns a function from a list of texts to one
    Arrow array per field; a list holds at most `rows` texts of `chars` bytes together. Columns that are neither keys nor the text are not read, so
    their names cannot clash; a key named like a result is an error.
    """
    clash = set(keys) & {f.name for f in fields}
    if clash:
        raise ValueError(f"key columns named like results: {sorted(clash)}")
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + list(fields))
    names = [f"k{i}" for i in range(len(keys))]
    # A text that is kept as well goes to Python once: batches hold thousands of texts, in the JVM and in the worker.
    kept = text in keys and df.schema[text].dataType.simpleString() == kind
    body = names[list(keys).index(text)] if kept else "t"
    picked = df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), *([] if kept else [F.col(f"`{text}`").cast(kind).alias(body)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, body, rows, chars):
                made = list(work(part.column(body).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=schema.names)

    return picked.mapInArrow(trimmed(make.__module__.rpartition(".")[2], run), schema)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder, under a name that tells what it is, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, 'llm')}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.folder = path
    return back


#: Seconds between two collections of what the driver no longer holds.
COLLECT_SECONDS = 20
_collected = 0.0


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read any more, as what came of them is written itself.

    Now and then, what the driver no longer holds is let go too, so that Spark deletes its shuffle files, on all machines.
    """
    global _collected
    for table in tables:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if time.monotonic() - _collected > COLLECT_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def text_key(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


#: Parts into which rows of like count are told apart by a hash.
TIE_PARTS = 4096


def most_frequent(counts: DataFrame, size: int, n: str = "n") -> DataFrame:
    """The `size` rows with the largest counts, or all if there are fewer.

    Counts are told apart by steps of 1/16 of a doubling; of the last step that does not fit as a whole, the
    rows of least hash of their other columns are taken, so equal counts fill the list too. What
    comes to the driver are histograms of steps and of TIE_PARTS parts of a step, and no task sends more than it has of the result.
    """
    def fitting(rows: DataFrame, by: Column, room: int) -> tuple[int | None, int]:
        """Down to which value whole groups fit (None: all), and the room that is left."""
        for row in rows.groupBy(by.alias("by")).count().orderBy(F.desc("by")).collect():
            if row["count"] > room:
                return row["by"], room
            room -= row["count"]
        return None, room

    step = F.floor(F.log2(F.col(n)) * 16)
    split, room = fitting(counts, step, size)
    if split is None:
        return counts
    whole, ties = counts.where(step > split), counts.where(step == split)
    others = [F.col(f"`{c}`") for c, t in counts.dtypes if c != n and not t.startswith("map")]
    order = F.xxhash64(*others)
    part = F.pmod(order, F.lit(TIE_PARTS))
    split, room = fitting(ties, part, room)
    last = ties.where(part == split).orderBy(order, *others).limit(room)
    return whole.unionByName(ties.where(part > split)).unionByName(last)
