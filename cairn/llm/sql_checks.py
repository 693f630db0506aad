"""Queries of what SQL can say of the operators' results: base counts, folds, sizes, and properties that hold for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import op1_quality, op2_minhash, op3_rules, op4_secrets, op6_language, op8_sharding, op9_packing, op10_sentencepiece
from cairn.llm.common import read_table

_SPACE = r"\x20\x09-\x0D"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))))"""


def l1_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out folds of op1 and op6, and op1's verdict by its score."""
    one = op1_quality.op1_quality(spark, sf_dir).select("doc_id", F.col("held_out").alias("fold1"), ((F.col("score") >= 0.7).cast("int") == F.col("predicted")).alias("agrees"))
    six = op6_language.op6_language(spark, sf_dir).select("doc_id", F.col("held_out").alias("fold6"))
    return one.join(six, "doc_id")


def l2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their number of copies, which are all of one class and of which no more than one is kept."""
    rows = op2_minhash.op2_minhash(spark, sf_dir).join(read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    by = rows.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), (F.min("class_id") == F.max("class_id")).alias("one_class"), (F.sum(F.col("kept").cast("int")) <= 1).alias("one_kept"))
    return by


def l3_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_rules.op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def l4_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets.op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def l6_und(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_language.op6_language(spark, sf_dir).select("doc_id", (F.col("lang_pred") == "und").alias("und"))


def l8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_sharding.op8_sharding(spark, sf_dir).select("doc_id", "size", "law")


def l8_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of all shards; slots are gapless and sizes near equal."""
    by = op8_sharding.op8_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("top"))
    return by.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes"), F.count("*").alias("shards"), F.bool_and((F.col("slots") == F.col("n")) & (F.col("top") == F.col("n") - 1)).alias("gapless"), (F.max("b") * 8 < F.sum("b") * 1.1).alias("near_equal"))


def l9_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces follow each other and are all its ids."""
    by = op9_packing.op9_packing(spark, sf_dir).groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole"), F.min("start").alias("first"))
    return by


def l9_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that are neither full nor a power of two, overlap or leave gaps: none."""
    by = op9_packing.op9_packing(spark, sf_dir).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.min("offset").alias("low"))
    bad = by.filter("n <> stop OR low <> 0 OR (n <> 4096 AND n & (n - 1) <> 0)")
    return bad.agg(F.count("*").alias("bad"))


def l10_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with dropout and decoded."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = op10_sentencepiece.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return op10_sentencepiece.decode(ids, path).select("doc_id", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (l1_folds, l2_copies, l3_base, l4_base, l6_und, l8_sizes, l8_law, l9_whole, l9_sequences, l10_decoded)}
ORACLES = {
    "l1_folds": f"SELECT doc_id, {_CRC} % 4 = 2 AS fold1, {_CRC} % 5 = 0 AS fold6, true AS agrees FROM documents",
    "l2_copies": "SELECT md5(coalesce(text, '')) AS digest, count(*) AS n, true AS one_class, true AS one_kept FROM documents GROUP BY 1",
    "l3_base": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w) t),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) t WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 8)) AS at FROM twice) t GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')))) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "l4_base": """
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex FROM documents""",
    "l6_und": "SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '\\p{L}') AS und FROM documents",
    "l8_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "l8_law": "SELECT count(*) AS rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes, CAST(8 AS BIGINT) AS shards, true AS gapless, true AS near_equal FROM documents",
    "l9_whole": "SELECT doc_id, true AS whole, CAST(0 AS BIGINT) AS first FROM documents",
    "l9_sequences": "SELECT CAST(0 AS BIGINT) AS bad",
    "l10_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
