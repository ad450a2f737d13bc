"""Quality of documents: base rules, and the likelihood ratio of trusted texts to the raw corpus.

Method. The words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are
counted, one on trusted documents and one on the whole raw corpus (both with one added to every bucket). The score of a
document is the logarithm of the likelihood ratio of the two, divided by its number of words and pairs. A document is
kept if no base rule fails it and its score is at least the mean score of the trusted documents less ``DEVIATIONS``
standard deviations; the threshold is a figure of the corpus and every document is held against it.

Everything is made of DataFrame functions. Words are cut once per pass and become arrays of hashes inside their row; only the bucket
counts move, pre-aggregated in each task. The table of trusted ids is broadcast up to ``BROADCAST_IDS`` and joined by a
shuffle beyond that.

Windows of eight words are compared by 64-bit hashes inside one text. Defined results: null and empty texts have no words, all
counts 0, score 0, and fail; without trusted documents every score is 0 and the base rules alone decide; repeated rows get equal
results; a null id is never trusted; extra columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.saved import saved

BUCKETS = 10_000
DEVIATIONS = 3.0
BROADCAST_IDS = 2_000_000
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
_POSITION_BITS = 24
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def word_arrays(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``words``, their hashes ``h1`` and the hashes ``h2`` of neighbouring pairs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs.withColumn("words", F.array_remove(F.split(whole, SEPARATORS), ""))
    hashed = cut.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("h2", _joined("h1", 1))


def _joined(name: str, shift: int) -> Column:
    """Hash of each element with the one ``shift`` places on."""
    n = F.greatest(F.size(name) - shift, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))


def _repeated(docs: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``, the words inside windows that occur twice or more, from the pair hashes ``h2``."""
    windows = docs.withColumn("h4", _joined("h2", 2)).withColumn("h8", _joined("h4", 4)).drop("h4")
    many = windows.withColumn("again", F.size(F.array_distinct("h8")) < F.size("h8"))
    # Sorted numbers of hash bits and position; neighbours with equal hash bits are candidates.
    low = F.lit((1 << _POSITION_BITS) - 1)
    packed = F.transform("h8", lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    many = many.withColumn("sorted", F.when(F.col("again"), F.sort_array(packed)))
    mark = F.filter("sorted", lambda x, i: (_bits(x) == _bits(F.get("sorted", i - 1))) | (_bits(x) == _bits(F.get("sorted", i + 1))))
    many = many.withColumn("places", F.sort_array(F.transform(mark, lambda x: x.bitwiseAND(low).cast("int")))).drop("sorted")
    # Equal in the packed bits only: those whose whole hash is single among the candidates drop out (hardly ever any).
    many = many.withColumn("full", F.sort_array(F.transform("places", lambda p: F.get("h8", p))))
    twice = F.filter("full", lambda x, i: (x == F.get("full", i - 1)) | (x == F.get("full", i + 1)))
    many = many.withColumn("single", F.array_except("full", twice)).drop("full")
    many = many.withColumn("places", F.when(F.size("single") > 0, F.filter("places", lambda p: ~F.array_contains("single", F.get("h8", p)))).otherwise(
        F.col("places"))).drop("single", "h8")
    covered = F.aggregate("places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return many.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0).cast("long"))).drop("places", "again")


def _bits(x: Column) -> Column:
    return F.shiftright(x, _POSITION_BITS)


def trusted_flag(docs: DataFrame, trusted: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Add ``trusted`` to documents whose id is among the trusted ids."""
    ids = trusted.where(F.col(row_id).isNotNull()).select(row_id).distinct().withColumn("trusted", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, row_id, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def bucket_weights(flagged: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the shares of each bucket; one number per bucket reaches the driver."""
    grams = flagged.select("trusted", F.explode(F.concat("h1", "h2")).alias("h"))
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good"))
    raw, good = [1] * buckets, [1] * buckets
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    all_raw, all_good = sum(raw), sum(good)
    if all_good == buckets:
        return [0.0] * buckets
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw)]


def judge(docs: DataFrame, trusted: DataFrame, row_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
          deviations: float = DEVIATIONS) -> DataFrame:
    """Row id, the counts of the base rules, base_failed, score and kept of every document."""
    plain = docs.select(F.col(row_id), F.col(text).alias("text"))
    flagged = trusted_flag(plain, trusted, row_id)
    values = bucket_weights(word_arrays(flagged), buckets)
    weights = F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")  # folded to one constant
    arrays = word_arrays(flagged)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = arrays.withColumn("lines", lines).select(
        row_id, "trusted", "h1", "h2", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))

    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0.0), lambda acc, h: acc + F.get(weights, F.pmod(h, F.lit(buckets)).cast("int")))

    size = F.size("h1") + F.size("h2")
    scored = counted.withColumn("score", F.when(size > 0, (total("h1") + total("h2")) / size).otherwise(F.lit(0.0))).drop("h1")
    done = saved(_repeated(scored).drop("h2"), "quality")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    figures = done.where("trusted and n_words > 0").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    threshold = round(figures["m"] - deviations * figures["s"], 6) if figures["m"] is not None else 0.0
    return done.select(row_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                       (~base_failed & (F.col("score") >= threshold)).alias("kept"), "score")
