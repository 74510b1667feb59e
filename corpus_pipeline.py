"""The pipeline over documents: each stage applies one operator of veilframe.llm.

Each stage works on all that the one before kept; what it returns is written and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import bpe, decontaminate, jaccard, langid, secrets
from veilframe.llm.common import written
from veilframe.llm.queries import bpe_files, table

#: Documents in several languages whose best has a smaller share than this are rejected.
#: The score compares the labels' languages with one another: with K of them, a text read as one has at least 1/K.
LEAST_SCORE = 0.2
#: So are those with less of their letters in words, or parts of words, that the labelled texts have.
LEAST_KNOWN = 0.5


def coded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of other names, which clash with nothing, and these names."""
    names = {n: f"column_{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language that the labels know, without letters, and without evenly mixed ones.

    Null texts go; repeated rows stay or go together; without labels none stays, an empty table stays empty. Columns may have any names.
    """
    rows, names = coded(docs)
    found = langid.identify(rows, langid.fit(docs), tuple(names.values()), names["text"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("known") >= LEAST_KNOWN))
    return kept.select(*names.values()).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates.

    Repeated rows become one; documents without words are nobody's duplicate, rows of one doc_id stay or go together.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item; null texts and, without items, all documents stay."""
    return decontaminate.clean(docs, decontaminate.build(table(spark, sf_dir, "benchmark"), docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, encoded ones too; n_chars follows the text. Null texts stay null."""
    rows, names = coded(docs)
    made = secrets.mask(rows, tuple(c for n, c in names.items() if n != "text"), names["text"], out=names["text"])
    if "n_chars" in names:
        made = made.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return made.select(*names.values()).toDF(*names)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it again; null texts have no ids."""
    ranks, pattern = bpe_files()
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    back = bpe.round_trip(texts, ranks, pattern, ("doc_id", "sha256"))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha256")).alias("round_trip"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("byte_bpe", byte_pairs),
]
#: SQL can't express the language model or the latent space; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
