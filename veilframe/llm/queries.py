"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.llm import bpe, chat, counts, decontaminate, html, jaccard, langid, media, ordermin, repair, secrets, surrogates, trie
from veilframe.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of the ids and of the decoded bytes."""
    ranks, pattern = bpe_files()
    back = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingle count and near-duplicate component of every document: five words, similarity 0.8."""
    return jaccard.components_of(table(spark, sf_dir, "documents"), k=5, percent=80)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and a digest of those in the text itself, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
                        F.size(F.filter("secrets", lambda s: ~s["base"])).cast("long").alias("n_decoded"))


def held_out() -> Column:
    """The documents that language models are not learned from; a null doc_id counts as not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds, as pairs."""
    docs = table(spark, sf_dir, "documents")
    index = decontaminate.build(table(spark, sf_dir, "benchmark"), docs)
    return decontaminate.leaks(docs, index).withColumnRenamed("item", "item_id")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages"), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored, read back and measured."""
    docs = table(spark, sf_dir, "documents")
    index = media.with_headers(media.store(docs))
    index = media.read_back(index).select("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    rows = media.with_references(docs)
    return rows.join(written(index, "read"), "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings: to records, canonical turns and text, and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit("</s>[INST] ok [/INST]").alias("text"))
    records = chat.canonical(chat.records_of(given.unionByName(control)), ("conv_id", "part"))
    segments = chat.formatted(chat.turns_table(records)).select("conv_id", "part", "place", "segment", "mask_start", "mask_end")
    return chat.digests(chat.read_back(segments), "conv_id", ["part", "place"])


@query
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    made = surrogates.with_surrogates(table(spark, sf_dir, "documents"), key="key of the registered query")
    return made.select("doc_id", "text", "n_mentions")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document, with the pieces and scores of PIECES taken as a unigram vocabulary."""
    import public_tokenizers

    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how near that and the next document are."""
    return ordermin.edit_likeness(table(spark, sf_dir, "documents"))


#: The repair by a plain recursion over rows from the last to the first, in which each state carries its whole edit list and text.
CHECKS["op12_conversation_repair"] = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT DISTINCT key, 0 AS k, 4294967295::UBIGINT AS v FROM given
  UNION ALL
  SELECT key, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, ascii(substr(key, k // 9 + 1, 1))::UBIGINT)
                          ELSE xor(v >> 1, 3988292384::UBIGINT * (v & 1)) END FROM crc WHERE k < 9 * length(key)),
kinds AS (SELECT key, xor(v, 4294967295::UBIGINT) % 20 AS kind FROM crc WHERE k = 9 * length(key)),
hurt AS (
  SELECT conv_id, turn, role AS given, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, c
  FROM given JOIN kinds USING (key), unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) u(c) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, given, sha256(text), c)),
faulty AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
best AS (
  SELECT DISTINCT conv_id, n AS i, {'cost': 0, 'audit': '', 'said': ''} AS b0, {'cost': 10, 'audit': 'II', 'said': E'user:\nassistant:\n'} AS bs,
         {'cost': 5, 'audit': 'I', 'said': E'assistant:\n'} AS bu, {'cost': 0, 'audit': '', 'said': ''} AS ba FROM placed
  UNION ALL
  SELECT conv_id, i,
    list_min([c0, {'cost': eu.cost + 5, 'audit': 'I' || eu.audit, 'said': E'user:\n' || eu.said}]),
    list_min([cs, {'cost': eu.cost + 5, 'audit': 'I' || eu.audit, 'said': E'user:\n' || eu.said}]), eu,
    list_min([ca, {'cost': cu.cost + 5, 'audit': 'I' || cu.audit, 'said': E'user:\n' || cu.said}])
  FROM (
    SELECT *, list_min([cu, {'cost': ca.cost + 5, 'audit': 'I' || ca.audit, 'said': E'assistant:\n' || ca.said}]) AS eu
    FROM (
      SELECT conv_id, i,
        list_min([d0, CASE WHEN stays AND initial = 's' THEN {'cost': bs.cost + more, 'audit': 'K' || bs.audit, 'said': own || bs.said} END,
                  CASE WHEN stays AND initial = 'u' THEN ku END, ru]) AS c0,
        list_min([ds, CASE WHEN stays AND initial = 'u' THEN ku END, ru]) AS cs,
        list_min([du, CASE WHEN stays AND initial = 'a' THEN {'cost': ba.cost + more, 'audit': 'K' || ba.audit, 'said': own || ba.said} END,
                  CASE WHEN stays THEN {'cost': ba.cost + more + 1, 'audit': 'R' || ba.audit, 'said': 'assistant:' || text || chr(10) || ba.said} END]) AS cu,
        list_min([da, CASE WHEN stays AND initial = 'u' THEN ku END, ru]) AS ca
      FROM (
        SELECT b.conv_id, b.i - 1 AS i, b.bs, b.ba, f.initial, f.text, f.fault IN ('', 'truncated') AS stays,
               CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, f.role || ':' || f.text || chr(10) AS own,
               {'cost': b.bu.cost + more, 'audit': 'K' || b.bu.audit, 'said': own || b.bu.said} AS ku,
               CASE WHEN stays THEN {'cost': b.bu.cost + more + 1, 'audit': 'R' || b.bu.audit, 'said': 'user:' || f.text || chr(10) || b.bu.said} END AS ru,
               {'cost': b.b0.cost + 2, 'audit': 'D' || b.b0.audit, 'said': b.b0.said} AS d0, {'cost': b.bs.cost + 2, 'audit': 'D' || b.bs.audit, 'said': b.bs.said} AS ds,
               {'cost': b.bu.cost + 2, 'audit': 'D' || b.bu.audit, 'said': b.bu.said} AS du, {'cost': b.ba.cost + 2, 'audit': 'D' || b.ba.audit, 'said': b.ba.said} AS da
        FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i))))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.b0.cost, 0) AS BIGINT) AS cost, coalesce(b.b0.audit, '') AS audit,
       sha256(coalesce(CASE WHEN b.b0.said = '' THEN '' ELSE substr(b.b0.said, 1, length(b.b0.said) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 0
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, its faults, the least edits that mend it, and a digest of what they give."""
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


#: The trie with all rebuilt sequences written out and every node joined to all nodes above it; the checksum is made bit by bit.
CHECKS["op13_prefix_trie"] = """
WITH RECURSIVE rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, 4294967295::UBIGINT AS v FROM rows_
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN k % 9 = 0 THEN xor(v, ascii(substr(s, k // 9 + 1, 1))::UBIGINT)
                                 ELSE xor(v >> 1, 3988292384::UBIGINT * (v & 1)) END
  FROM crc WHERE k < 9 * length(s)),
heads AS (SELECT conv_id, CAST(xor(v, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM crc WHERE k = 9 * length(s)),
own AS (
  SELECT conv_id, list(struct_pack(id := md5(length(role) || ':' || role || text), n := length(text))
                       ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS turns FROM rows_ GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
members AS (
  SELECT conv_id, d, len(turns) AS total, coalesce(turns[d].n, 0) AS n_chars,
         array_to_string(list_transform(turns[1:d], lambda t: t.id), ',') AS node
  FROM rebuilt, unnest(range(0, len(turns) + 1)) u(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars, max(total) AS deepest,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d) AS ends FROM members GROUP BY node, d),
above AS (
  SELECT substr(node, 1, CAST(greatest(33 * a - 1, 0) AS BIGINT)) AS node, a AS d, sum((n_convs - 1) * n_chars) AS saved,
         count(*) FILTER (deepest = nodes.d) AS leaves, count(*) FILTER (nodes.d = a + 1) AS children
  FROM nodes, unnest(range(0, nodes.d + 1)) u(a) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, a.children AS n_children, a.leaves AS n_leaves,
       CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN above a USING (node, d)
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = substr(n.node, 1, CAST(greatest(33 * (n.d - 1) - 1, 0) AS BIGINT))
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
