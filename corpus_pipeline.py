"""A corpus from raw documents to piece ids. Each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import benchmarks, jaccard, language, passages, pieces
from tallyhouse.llm.queries import table, with_code
from tallyhouse.llm.saved import saved

LEAST_SHARE = 1 / 3


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that clash with none that an operator adds, and the name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters go, and those in which no language has a third of the words.

    With four languages the second takes four nearly equal shares, so what goes is in practice the unknown language alone. Texts
    in a language without labels are not detected. Texts without any label to learn from are an error.
    """
    with_code(spark)
    model = language.train(docs.where(language.fold() != 2))
    if not model.langs and not docs.where("text is not null").isEmpty():
        raise ValueError("no text outside the held-out fold has a lang, so no language can be told")
    plain, name = _plain(docs)
    judged = language.predict(plain, model, name["text"])
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col(n).alias(c) for c, n in name.items()])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id."""
    with_code(spark)
    return jaccard.one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go; all documents stay, and the texts of those without repeats are unchanged."""
    with_code(spark)
    plain, name = _plain(docs)
    done = passages.remove_repeated(plain, name["text"], name["doc_id"])
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])}
    return done.select(*[(F.when(changed, new[c]).otherwise(F.col(n)) if c in new else F.col(n)).alias(c) for c, n in name.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return benchmarks.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text that is left, checked by decoding them."""
    with_code(spark)
    return pieces.encode_and_check(docs, pieces.default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None  # SQL cannot express the language mixture, the MinHash bands or the piece search


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
