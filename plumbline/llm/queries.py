"""The operators bound to the test tables, one query each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat_format, contamination, licenses, lm_mixing, merkle, multi_index, prefix_trie, quality, warc
from plumbline.llm.ngram_join import jaccard_components
from plumbline.llm.packing import packed
from plumbline.llm.substring_dedup import repeated_passages
from plumbline.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under the mixing model, beside the unigram base score."""
    return lm_mixing.scored(table(spark, sf_dir, "documents"))


@query
def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives it was written to."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the exact share of its shingles they hold."""
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one whose texts look like control strings."""
    odd = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").unionByName(planted)
    return chat_format.digests(chat_format.formatted(talks))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document after repeated passages of 35 words or more are removed."""
    found = repeated_passages(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that state a licence, with its family."""
    return licenses.licence_paragraphs(table(spark, sf_dir, "documents"))


@query
def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, from the votes of its nearest labelled neighbours."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the conversations, rebuilt so that families share their first turns.

    ``n_convs`` counts members, ``n_leaves`` childless nodes of the subtree; ``saved_tokens`` is the sum over
    the subtree of each node's (n_convs - 1) times the code points of its last text; ``ends_sha256`` is the digest of the
    comma-joined ids of members that end at the node.
    """
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text through a table of distinct words, and the text that they decode to."""
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), with_text=True))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the proof holds after tampering with a third of them."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


ORACLES["op4_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '[SYS]', ''))) // 5 + (length(text) - length(replace(text, '[/SYS]', ''))) // 6
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[ROLE]', ''))) // 6 + (length(text) - length(replace(text, '[SAYS]', ''))) // 6
    + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS chars,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
         AND arg_max(role, turn) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

ORACLES["op2_warc_archives"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > page_id THEN kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
