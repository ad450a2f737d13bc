"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import os
import tempfile
import zipfile

import tallyhouse
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    alignment, backoff, benchmarks, extraction, jaccard, language, linkgraph, passages, pieces, quality, sharding, tokenfiles, whitening)
from tallyhouse.session import scratch_path


BATCH_ROWS = "1000"  # of whole texts, in an exchange with a Python worker


def with_code(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers, once per application; they need not have it installed.

    Rows are exchanged with them in small batches, since each holds a whole text.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_tallyhouse_code", False):
        return spark
    root = os.path.dirname(os.path.abspath(tallyhouse.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyhouse-code-"), "tallyhouse_code.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.join("tallyhouse", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tallyhouse_code = True
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return with_code(spark).read.parquet(f"{sf}/{name}.parquet")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_sharding(spark, sf):
    return sharding.assign(table(spark, sf, "documents")).select("doc_id", "shard", "depth", "page", "n_bytes")


def op2_url_filters(spark, sf):
    judged = linkgraph.judge(table(spark, sf, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op3_lm_scoring(spark, sf):
    return backoff.score(table(spark, sf, "documents"))


def op4_substring_dedup(spark, sf):
    return passages.remove_repeated(table(spark, sf, "documents"), with_text=False, keep=["doc_id"])


def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(language.fold() != 2))
    held_out = F.coalesce(language.fold() == 2, F.lit(False)).alias("held_out")
    return language.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out, "lang_pred", "score", "langs")


def op6_ngram_jaccard_join(spark, sf):
    return jaccard.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "copy_id", "n_links")


def op7_benchmark_decontamination(spark, sf):
    return benchmarks.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_html_extraction(spark, sf):
    found = extraction.extract(table(spark, sf, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_quality_rules(spark, sf):
    trusted = table(spark, sf, "labels").where("quality = 1 and toxic = 0")
    return quality.judge(table(spark, sf, "documents"), trusted)


def op10_sentencepiece(spark, sf):
    return pieces.encode_and_check(table(spark, sf, "documents"), pieces.default_vocabulary())


def op11_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    tokenfiles.write(table(spark, sf, "documents"), path, tokenfiles.default_tokenizer())
    return tokenfiles.checksums(spark, path)


def op12_cross_tokenizer_alignment(spark, sf):
    return alignment.align(table(spark, sf, "documents"), *alignment.default_paths())


def op13_embedding_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))


# The shard of a row is the shortest prefix of its key's bits whose bucket fits, or the first that has one row.
OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS bits, coalesce(strlen(text), 0) AS n_bytes FROM documents),
levels AS (SELECT doc_id, n_bytes, bits, unnest(range(0, 61)) AS depth FROM sized),
buckets AS (
  SELECT depth, bits >> CAST(60 - depth AS INTEGER) AS prefix, sum(n_bytes) AS bytes, count(*) AS n FROM levels GROUP BY 1, 2),
fitting AS (
  SELECT l.doc_id, l.n_bytes, l.bits, min(l.depth) AS depth FROM levels l
  JOIN buckets b ON b.depth = l.depth AND b.prefix = l.bits >> CAST(60 - l.depth AS INTEGER)
  WHERE b.bytes <= {sharding.LIMIT_BYTES} OR b.n = 1 GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE left(lpad(bin(bits), 60, '0'), CAST(depth AS INTEGER)) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, CAST(n_bytes AS BIGINT) AS n_bytes
FROM fitting
"""

QUERIES = {
    "op1_sharding": (op1_sharding, OP1_SQL),
    "op2_url_filters": (op2_url_filters, None),
    "op3_lm_scoring": (op3_lm_scoring, None),
    "op4_substring_dedup": (op4_substring_dedup, None),
    "op5_language_id": (op5_language_id, None),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, None),
    "op7_benchmark_decontamination": (op7_benchmark_decontamination, None),
    "op8_html_extraction": (op8_html_extraction, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_sentencepiece": (op10_sentencepiece, None),
    "op11_token_files": (op11_token_files, None),
    "op12_cross_tokenizer_alignment": (op12_cross_tokenizer_alignment, None),
    "op13_embedding_whitening": (op13_embedding_whitening, None),
}
