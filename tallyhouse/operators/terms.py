"""Term counts over whole texts, and the complement model built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import PUNCTUATION, let, tokens, typo_pattern
from tallyhouse.operators.factors import Blocks, cut
from tallyhouse.session import kept_table

# Words of links that say nothing about the platform.
URL_STOPWORDS = (
    "http https www com br da de do php id pt hl top search ref org nametag profile igshid web content as ao utm view "
    "people dos user pg fbid about in filter htpp htpps source fbclid login posts admin"
).split()


def exploded(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row per word. The outer form keeps Spark from testing the computed array for
    emptiness first, which would cut every text into words once more."""
    return df.select(*keep, F.explode_outer(words).alias("token")).where("token IS NOT NULL")


def frequent_names(names: DataFrame, column: str, more_than: int) -> DataFrame:
    """Words seen more than ``more_than`` times in a column of names."""
    words = names.select(F.explode(tokens(F.regexp_replace(column, r"\d+", " "), accents=True)).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("token")


def link_words(col: Column) -> Column:
    """Words of a link: punctuation to spaces, digits dropped."""
    return tokens(F.regexp_replace(F.translate(F.lower(col), PUNCTUATION, " " * len(PUNCTUATION)), r"\d+", ""), accents=True)


def ngram_counts(
    df: DataFrame, key: str, words: Column, min_df: int = 1, stopwords: Sequence[str] = (), names: DataFrame | None = None
) -> DataFrame:
    """Total count and document count of words and word pairs found in >= ``min_df`` documents.

    Each document emits its terms once for the totals and once, deduplicated, for the
    document count, so that both are plain sums combined before the only shuffle. Words of
    the list ``stopwords`` are tested in place; those of a table ``names`` are taken out by a
    join on the words, after which each document is put together again.
    """
    if stopwords:
        words = F.filter(words, lambda t: ~t.isin(*stopwords))
    base = df.select(F.col(key).alias("_key"), words.alias("_w"))
    if names is not None:
        flat = base.select("_key", F.posexplode("_w").alias("_p", "token")).join(names, "token", "left_anti")
        base = flat.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_p", "token"))).alias("_s")).select(
            "_key", F.col("_s.token").alias("_w")
        )

    def with_pairs(w: Column) -> Column:
        ends = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, ends), F.slice(w, 2, ends), lambda a, b: F.concat_ws(" ", a, b)))

    def entries(t: Column) -> Column:
        once = F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d")))
        return F.concat(F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))), once)

    terms = base.select(let(F.col("_w"), lambda w: let(with_pairs(w), entries)).alias("_e"))
    counted = terms.select(F.explode_outer("_e").alias("c")).where("c IS NOT NULL").groupBy("c.term").agg(
        F.sum("c.n").alias("n"), F.sum("c.d").alias("n_docs")
    )
    return counted.where(F.col("n_docs") >= min_df)


def vocab_size(df: DataFrame, text: str) -> DataFrame:
    """Distinct words of a corpus, accents and case ignored."""
    words = exploded(df, F.array_distinct(tokens(F.col(text))))
    return words.agg(F.count_distinct("token").alias("vocabulary"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words of each document with their counts (long form of a term matrix)."""
    words = exploded(df, tokens(F.col(text)), key)
    return words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def word_blocks(df: DataFrame, row: str, words: Column) -> Blocks:
    """Counts of the words of each row, by blocks.

    Words are counted where the row is read, without a shuffle. Only rows whose key comes again, or is null, are added up first; those
    without a key count as a single row, which has no vector.
    """
    again = df.groupBy(F.col(row).alias("_row")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 OR _row IS NULL").select("_row")
    again = kept_table(again, "again")
    once, added = df, None
    if not again.isEmpty():
        same = F.col(row).eqNullSafe(F.col("_row"))
        once = df.join(again, same, "left_anti")
        counts = exploded(df.join(again, same, "left_semi"), words, row).groupBy(row, "token").agg(F.count(F.lit(1)).cast("double").alias("w"))
        added = counts.groupBy(row).agg(F.collect_list(F.struct("token", "w")).alias("e"))
        added = cut(added.select(F.col(row).alias("id"), F.col("e.token").alias("c"), F.col("e.w").alias("w")))
    blocks = cut(once.select(F.col(row).alias("id"), words.alias("c")))
    return Blocks(kept_table(blocks if added is None else blocks.unionByName(added), "counts"))


def multi_column_counts(parts: Sequence[tuple[DataFrame, float]], key: str, agg: str = "max") -> DataFrame:
    """Weighted counts of several text columns over one vocabulary, added up or maximised."""
    long = reduce(
        DataFrame.unionByName, [df.select(key, "token", (F.col("n") * F.lit(float(w))).alias("n")) for df, w in parts]
    )
    return long.groupBy(key, "token").agg({"max": F.max, "sum": F.sum}[agg]("n").alias("n"))


def weighted_counts(counts: DataFrame, keywords: Sequence[str], anti: Sequence[str], weight: float) -> DataFrame:
    """Counts multiplied by ``weight`` for the words of ``keywords`` that are not in ``anti``.

    Both lists are texts and go through the same tokens as the documents.
    """
    spark = counts.sparkSession
    words = lambda texts: spark.createDataFrame([(t,) for t in texts] or [("",)], "t STRING").select(
        F.explode(tokens(F.col("t"))).alias("token")
    ).distinct()
    keys = words(keywords).join(words(anti), "token", "left_anti").withColumn("_k", F.lit(1))
    joined = counts.join(F.broadcast(keys), "token", "left")
    return joined.select(
        *[c for c in counts.columns if c != "n"],
        F.when(F.col("_k") == 1, F.col("n") * F.lit(float(weight))).otherwise(F.col("n").cast("double")).alias("n"),
    )


def typo_matches(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """Words that are a listed term up to slips onto neighbouring keys, with their counts.

    Words of the corpus are counted first; only distinct words meet the patterns.
    """
    words = exploded(df, tokens(F.col(text))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = F.array_compact(F.array(*[F.when(F.col("token").rlike(typo_pattern(t)), t) for t in terms]))
    return words.select(F.explode(found).alias("term"), "token", "n")


def complement_weights(counts: DataFrame, labels: DataFrame, key: str, label: str, alpha: float) -> DataFrame:
    """Complement class weights: -log of the smoothed share of a word outside the class.

    ``counts`` is (key, token, n); the result has one row per class and word of the
    vocabulary. Classes are few, so per-class sums are laid out with one row per word.
    """
    classed = counts.join(labels.select(key, F.col(label).cast("int").alias("_y")), key)
    per = classed.groupBy("token").agg(
        F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("n"))), F.lit(0)).alias("_pos")
    )
    totals = per.agg(
        F.sum("_all").alias("a"), F.sum("_pos").alias("p"), F.count(F.lit(1)).alias("v")
    )
    both = per.withColumn("_t", totals.select(F.struct(*[F.col(c).cast("double").alias(c) for c in "apv"])).scalar())
    a, smooth = F.lit(float(alpha)), F.col("_t.v") * F.lit(float(alpha))
    w0 = -F.ln((F.col("_pos") + a) / (F.col("_t.p") + smooth))
    w1 = -F.ln((F.col("_all") - F.col("_pos") + a) / (F.col("_t.a") - F.col("_t.p") + smooth))
    return both.select("token", w0.alias("w0"), w1.alias("w1"))


def complement_scores(counts: DataFrame, weights: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Probability of class 0 and class 1: softmax of count-weighted class weights.

    Documents without a known word get equal probabilities.
    """
    sums = counts.join(weights, "token").groupBy(key).agg(
        F.sum(F.col("n") * F.col("w0")).alias("_s0"), F.sum(F.col("n") * F.col("w1")).alias("_s1")
    )
    gap = F.coalesce(F.col("_s1") - F.col("_s0"), F.lit(0.0))
    # 1 / (1 + e^gap), written so that neither branch overflows.
    p0 = F.when(gap > 0, F.exp(-gap) / (1 + F.exp(-gap))).otherwise(1 / (1 + F.exp(gap)))
    return docs.select(key).join(sums, key, "left").select(key, p0.alias("p0"), (1 - p0).alias("p1"))


def token_weights(weights: DataFrame, k: int) -> DataFrame:
    """The k words that pull most towards class 1 or class 0, with signed weight."""
    signed = weights.select("token", (F.col("w1") - F.col("w0")).alias("weight"))
    return signed.orderBy(F.abs("weight").desc(), "token").limit(k)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each class, divided by the value of class 0."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    base = counts.where(F.col(label) == 0).select(F.col("n").cast("double")).scalar()
    return counts.select(label, "n", F.try_divide(base, F.col("n").cast("double")).alias("weight"))


