"""Grouping of tagged model tokens into entities, and entity counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.columns import empty_like, fold_in_blocks, let, pinned
from veilframe.functions.labels import entity_name


def group_tags(tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entities from BIO tokens (key..., pos, word, entity, score).

    ``B-`` or a change of type starts an entity; ``##`` marks a continued word. The
    confidence is the mean score (0.95 where missing) in percent, to one digit.
    """
    w = Window.partitionBy(*key).orderBy("pos", "word")
    t = (tokens
         .withColumn("_type", F.upper(F.regexp_replace("entity", "^[BI]-", "")))
         .withColumn("_starts", F.col("entity").startswith("B-")
                     | F.coalesce(F.lag("_type").over(w) != F.col("_type"), F.lit(True)))
         .withColumn("_island", F.sum(F.col("_starts").cast("int")).over(
             w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_piece", F.regexp_replace("word", "^##", "")))
    score = F.coalesce(F.when(F.col("score") != 0, F.col("score")), F.lit(0.95))
    grouped = t.groupBy(*key, "_island").agg(
        F.min("pos").alias("first_pos"), F.first("_type").alias("type"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "_piece"))),
                    lambda p: p["_piece"]).alias("words"),
        F.round(F.avg(score) * 100, 1).alias("confidence"))
    grouped = grouped.withColumn("text", F.array_join("words", ""))
    return grouped.withColumn("label", entity_name(F.col("type"))).drop("_island")


def place_entities(entities: DataFrame, texts: DataFrame, key: Sequence[str],
                   text: str = "text") -> DataFrame:
    """Offsets of grouped entities: a cursor moves through the text in the order of the tags.

    An entity stands at the first place behind the one before it where its words follow one
    another, with or without blanks between, so the k-th mention of a name takes its k-th place.
    Where its words do not stand so any more, the first place of its first word in the whole text, in any case of
    letters, with the length of the joined words, and the cursor stays; else the text's start.
    All entities of one text meet in its row. Entities of texts that are not there are left out.
    """
    def quoted(word):
        return F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    place = F.struct(F.col("first_pos").alias("pos"), F.col("text").alias("name"), F.col("words"),
                     F.get(F.array_compact("words"), F.lit(0)).alias("head"), F.array_join("words", " ").alias("spaced"),
                     (~F.array_join("words", "\x01").rlike("(?:^|\\x01)(?:[\\s\\x01]|$)")).alias("plain"))
    rest = [c for c in entities.columns if c not in (*key, "text", "first_pos", "words")]
    gathered = entities.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        place.alias("p"), F.struct(*rest).alias("rest")))).alias("_entities"))
    joined = gathered.join(
        texts.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_body")), list(key))
    body = F.col("_body")

    nowhere = F.struct(F.lit(None).cast("string").alias("hit"), F.lit(None).cast("int").alias("at"))

    def sought(at, e):
        return let(F.regexp_substr(F.substring(body, at + 1, F.length(body)),
                                   F.array_join(F.transform(e["p"]["words"], quoted), r"\s*")),
                   lambda hit: F.struct(
                       hit.alias("hit"),
                       (F.instr(F.substring(body, at + 1, F.length(body)), hit) + at - 1).alias("at")))

    def found(at, e):
        """The first place behind the cursor: where its first word is next, if the others follow with one blank between.

        Words that are empty or begin with a blank leave a choice of blanks, which is the pattern's to make.
        """
        p = e["p"]
        return let(F.when(p["plain"], F.position(p["head"], body, at + 1)), lambda n: F.when(
            n == 0, nowhere).when(F.substring(body, n, F.length(p["spaced"])) == p["spaced"],
                                  F.struct(p["spaced"].alias("hit"), (n - 1).alias("at"))).otherwise(sought(at, e)))

    def step(state, e):
        """The cursor behind an entity, and what was found, so that it is looked for once."""
        return let(found(state["at"], e), lambda f: F.struct(F.when(
            f["hit"].isNotNull(), f["at"] + F.length(f["hit"])).otherwise(state["at"]).alias("at"), f.alias("found")))

    def placed(state, e):
        f = state["found"]
        first = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), quoted(F.get(e["p"]["words"], F.lit(0))))
        other = F.greatest(F.coalesce(F.instr(body, F.regexp_substr(body, first)), F.lit(0)) - 1, F.lit(0))
        length = F.length(F.coalesce(f["hit"], e["p"]["name"]))
        return let(F.when(f["hit"].isNotNull(), f["at"]).otherwise(other), lambda start: F.struct(
            start.alias("start"), (start + length).alias("end"), e.alias("e")))
    nothing = F.struct(F.lit(0).alias("at"), nowhere.alias("found"))
    spans = fold_in_blocks(
        F.col("_entities"), nothing, step, placed,
        F.transform(empty_like(F.col("_entities")), lambda e: F.struct(
            F.lit(0).alias("start"), F.lit(0).alias("end"), e.alias("e"))), after=True)
    # The places are unpacked from a column of their own, so that they are found once.
    return (joined.withColumn("_spans", pinned(spans))
            .select(*key, "_body", F.explode("_spans").alias("_s"))
            .select(*key, F.col("_s.e.p.pos").alias("first_pos"), F.col("_s.e.p.words").alias("words"),
                    "_s.e.rest.*", "_s.start", "_s.end",
                    F.substring("_body", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
                    .alias("text")))


def count_classes(entities: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Entities per class PER, LOC, ORG and MISC."""
    counts = [F.count_if(F.col("type") == c).alias(c) for c in ("PER", "LOC", "ORG", "MISC")]
    return entities.groupBy(*key).agg(*counts, F.count("*").alias("total"))


#: Characters of a text that are swept in one task.
BIN = 1 << 16


def _reach(rows: DataFrame, group: Sequence[str], place: str, order: Sequence, reach: Column) -> DataFrame:
    """Add ``_reach``: the largest ``reach`` (null: none) of a row's group before it in the order, by a sweep.

    A group is swept in bins of its places; what reaches over from earlier bins is a maximum of theirs,
    so a text with very many spans is many tasks. ``order`` must begin with the place.
    """
    rows = rows.withColumn("_bin", F.floor(F.col(place) / BIN)).withColumn("_to", reach)
    inside = Window.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*group, "_bin").agg(F.max("_to").alias("_most")).withColumn(
        "_over", F.max("_most").over(earlier)).drop("_most")
    return (rows.withColumn("_reach", F.max("_to").over(inside)).join(bins, [*group, "_bin"])
            .withColumn("_reach", F.greatest("_reach", "_over")).drop("_bin", "_to", "_over"))


def drop_known(contextual: DataFrame, model: DataFrame, key: Sequence[str]) -> DataFrame:
    """Contextual entities (a table) that no model entity of their text equals, or contains with the same type.

    Equal ones go by an equi-join; the others by one sweep over both lists in order of their starts.
    """
    names = contextual.columns
    places = model.select(*key, "start", "end").distinct()
    new = contextual.join(places, [*key, "start", "end"], "left_anti").select(*names)
    both = new.withColumn("_model", F.lit(False)).unionByName(
        model.select(*key, "start", "end", "type").withColumn("_model", F.lit(True)),
        allowMissingColumns=True)
    swept = _reach(both, [*key, "type"], "start", ["start", F.desc("_model")],
                   F.when(F.col("_model"), F.col("end")))
    return swept.filter(~F.col("_model") & (F.coalesce("_reach", F.lit(-1)) < F.col("end"))).select(*names)


def drop_overlapping_rows(entities: DataFrame, spans: DataFrame,
                          key: Sequence[str]) -> DataFrame:
    """Entities (a table) that touch no span of the same text.

    One sweep over both lists: spans in order of their starts, entities of their ends. An entity
    is touched if the spans that start before its end reach past its start.
    """
    names = entities.columns
    both = entities.withColumn("_at", F.col("end")).withColumn("_span", F.lit(False)).unionByName(
        spans.select(*key, "end", F.col("start").alias("_at")).withColumn("_span", F.lit(True)),
        allowMissingColumns=True)
    swept = _reach(both, key, "_at", ["_at", "_span"], F.when(F.col("_span"), F.col("end")))
    return swept.filter(~F.col("_span") & (F.coalesce("_reach", F.lit(-1)) <= F.col("start"))).select(*names)
