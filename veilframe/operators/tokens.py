"""Placeholders shared by all texts of a session or conversation.

Numbering is done on exploded spans: the first place of every value by a pre-aggregated
minimum, then a range partitioning by scope, kind and place, ranks inside its parts, and
the totals of the parts before. No task ever sees a whole session, so one session may hold
most of the data, whatever its order numbers are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veilframe.columns import pinned
from veilframe.functions.labels import ledger_type
from veilframe.lineage import cut_lineage, stored
from veilframe.operators.redact import splice


def span_rows(df: DataFrame, columns: Sequence[str], spans: str = "spans") -> DataFrame:
    """One row per span with the given columns beside it; the text is left behind."""
    # explode_outer, since a plain explode makes the optimizer copy the costly span
    # expression into a size filter below it.
    return (df.select(*columns, F.explode_outer(spans).alias("_span"))
            .filter(F.col("_span").isNotNull())
            .select(*columns, "_span.*"))


def number_values(rows: DataFrame, scope: Sequence[str], order: str,
                  kind: Callable[[Column], Column] = ledger_type,
                  known: DataFrame | None = None) -> DataFrame:
    """(scope..., value, kind, n, issued): the numbers of every distinct value of a scope.

    Values are numbered per kind (``n``) and over all kinds (``issued``) in order of first
    appearance: by ``order`` (a whole number, such as a turn or a document id), and inside
    one text from its right end. A value takes the kind of its first appearance.

    With ``known``, a table of values (scope..., value, kind, n, issued) that have their numbers,
    only new values are returned, and they are numbered behind the known ones.
    """
    first = rows.groupBy(*scope, "value").agg(F.min(F.struct(
        F.col(order).alias("at"), (-F.col("start")).alias("back"),
        kind(F.col("type")).alias("kind"))).alias("first"))
    first = first.select(*scope, "value", "first.*")
    if known is not None:
        first = first.join(known.select(*scope, "value"), [*scope, "value"], "left_anti")
    # Written, so that the parts are the same for ranks and totals; a scope has at
    # most as many parts as there are partitions.
    parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = cut_lineage(first.repartitionByRange(parts, *scope, "at", "back", "value")
                        .withColumn("part", F.spark_partition_id()))
    place = ("at", "back", "value")
    ranked = first.withColumn("issued", F.row_number().over(
        Window.partitionBy(*scope, "part").orderBy(*place)))
    ranked = ranked.withColumn("n", F.row_number().over(  # the same exchange serves
        Window.partitionBy(*scope, "kind", "part").orderBy(*place)))
    for group, number in (((*scope, "kind"), "n"), (tuple(scope), "issued")):
        totals = first.groupBy(*group, "part").agg(F.count("*").alias("m"))
        if known is not None:  # known values stand before the first part
            totals = totals.unionByName(known.groupBy(*group).agg(
                F.max(number).alias("m")).withColumn("part", F.lit(-1)))
        before = Window.partitionBy(*group).orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)
        totals = totals.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
        ranked = ranked.join(totals, [*group, "part"]).withColumn(
            number, F.col(number) + F.col("offset")).drop("offset")
    return ranked.select(*scope, "value", "kind", "n", "issued")


def ledger_placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), kind, F.lit("_"), n.cast("string"), F.lit("]"))


def gateway_placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_REDACTED_"), n.cast("string"), F.lit("]"))


def assign_placeholders(rows: DataFrame, scope: Sequence[str], order: str,
                        kind: Callable[[Column], Column] = ledger_type,
                        style: Callable[[Column, Column], Column] = ledger_placeholder,
                        known: DataFrame | None = None) -> DataFrame:
    """The token map of every scope: (scope..., placeholder, original, kind, n, issued).

    ``known`` is a token map whose values keep their placeholders; the result then holds the new ones only.
    """
    if known is not None:
        known = known.withColumnRenamed("original", "value")
    numbered = number_values(rows, scope, order, kind, known)
    return numbered.select(*scope, style(F.col("kind"), F.col("n")).alias("placeholder"),
                           F.col("value").alias("original"), "kind", "n", "issued")


def token_schema(rows: DataFrame, scope: Sequence[str]) -> T.StructType:
    """The schema of the token map that ``assign_placeholders`` makes of these rows."""
    fields = [rows.schema[s] for s in scope] + [
        T.StructField(n, T.StringType()) for n in ("placeholder", "original", "kind")]
    return T.StructType(fields + [T.StructField(n, T.LongType()) for n in ("n", "issued")])


def continue_session(rows: DataFrame, path: str, scope: Sequence[str], order: str,
                     kind: Callable[[Column], Column] = ledger_type,
                     style: Callable[[Column, Column], Column] = ledger_placeholder) -> DataFrame:
    """The token map stored under ``path``, after the values of these rows have got theirs.

    Values that the stored map has keep their placeholders; new ones are numbered behind the
    largest number of their scope and kind, and appended. A batch that is run again finds its
    values stored and adds none. One writer at a time may continue a session.
    """
    spark, schema = rows.sparkSession, token_schema(rows, scope)
    known = spark.read.schema(schema).parquet(path) if stored(spark, path) else spark.createDataFrame([], schema)
    made = assign_placeholders(rows, scope, order, kind, style, known)
    made.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def apply_placeholders(df: DataFrame, tokens: DataFrame, key: Sequence[str],
                       scope: Sequence[str], text: str = "text", spans: str = "spans",
                       out: str = "sanitized_text") -> DataFrame:
    """Replace every span by the placeholder its value has in the row's scope.

    Only texts that hold spans take part in the joins; the others pass straight
    through. The token side is unique per scope and value, so a value that stands in
    a large part of the texts is split by adaptive skew handling without copies.
    """
    columns = list(dict.fromkeys([*key, *scope]))
    body = F.coalesce(F.col(text), F.lit(""))
    clean = df.filter(F.size(spans) == 0).withColumn(out, body)
    dirty = df.filter(F.size(spans) > 0)
    named = (span_rows(dirty, columns, spans)
             .select(*columns, "start", "end", F.col("value").alias("original"))
             .join(tokens.select(*scope, "original", "placeholder"), [*scope, "original"])
             .groupBy(*key)
             .agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder")))
                  .alias("_places")))
    placed = dirty.join(named, list(key)).withColumn(out, pinned(
        splice(body, F.col("_places"), lambda s: s["placeholder"]))).drop("_places")
    return clean.unionByName(placed.select(*clean.columns))


def replace_spans(df: DataFrame, rows: DataFrame, tokens: DataFrame, key: Sequence[str],
                  scope: Sequence[str], text: str = "text", out: str = "sanitized_text",
                  count: str = "redacted_count") -> DataFrame:
    """Replace spans that are kept apart from their texts (rows of ``span_rows``) by their placeholders.

    Texts meet their places once, in one join on ``key``, which names a text; nulls in keys and
    scopes are values like others, so that no text stays as it was for want of a key.
    """
    def same(left, right, names):
        condition = F.lit(True)
        for name in names:
            condition = F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")) & condition
        return condition
    columns = list(dict.fromkeys([*key, *scope]))
    found = rows.select(*columns, "start", "end", F.col("value").alias("original")).alias("r")
    known = tokens.select(*scope, "original", "placeholder").alias("k")
    places = (found.join(known, same("r", "k", [*scope, "original"]))
              .groupBy(*[F.col(f"r.{k}").alias(k) for k in key])
              .agg(F.array_sort(F.collect_list(F.struct("r.start", "r.end", "k.placeholder"))).alias("_places")))
    joined = df.alias("d").join(places.alias("p"), same("d", "p", key), "left").select("d.*", "p._places")
    body = F.coalesce(F.col(text), F.lit(""))
    return joined.withColumns({
        out: F.when(F.col("_places").isNull(), body).otherwise(
            pinned(splice(body, F.col("_places"), lambda s: s["placeholder"]))),
        count: F.coalesce(F.size("_places"), F.lit(0))}).drop("_places")
