"""Text and tabular models on MLlib, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import CountVectorizer, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.hashing import uniform
from tallyhouse.functions.text import tokens
from tallyhouse.operators.factors import tf_idf, truncated_svd
from tallyhouse.operators.metrics import binary_metrics
from tallyhouse.operators.selection import exact_quantiles
from tallyhouse.operators.terms import word_blocks
from tallyhouse.session import kept_table

BatchScorer = Callable[[], Callable[[pd.Series], Sequence[float]]]


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(F.col(text)))


def score_texts(df: DataFrame, scorer: PipelineModel | BatchScorer, text: str = "text", threshold: float = 0.5, out: str = "hate_score") -> DataFrame:
    """Probability of each whole text and its class (1 above the threshold).

    ``scorer`` is a fitted MLlib model with a ``probability`` column, or a factory called
    once per task that returns a function from a batch of texts to probabilities, so a
    heavy model is loaded once per worker. Batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    if isinstance(scorer, Transformer):
        scored = scorer.transform(with_tokens(df, text)).withColumn(out, vector_to_array("probability")[1])
        scored = scored.select(*df.columns, out)
    else:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = scorer()
            for pdf in batches:
                yield pdf.assign(**{out: [float(p) for p in score(pdf[text])]})

        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        scored = df.mapInPandas(run, schema)
    return scored.withColumn("hate_class", (F.col(out) > threshold).cast("int"))


def text_classifier(kind: str, label: str, features: int = 1 << 16, weight: str | None = None, **params) -> Pipeline:
    """Pipeline from ``tokens`` to a classifier: ``logistic``, ``forest`` or ``bayes``.

    Words are hashed, so no vocabulary has to fit the driver.
    """
    tf = HashingTF(inputCol="tokens", outputCol="features", numFeatures=features)
    kinds = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "bayes": NaiveBayes}
    model = kinds[kind](labelCol=label, featuresCol="features", **params)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[tf, model])


def weighted_vote(df: DataFrame, models: Mapping[str, tuple[PipelineModel, float]], key: str, out: str = "vote") -> DataFrame:
    """Class most of the weight votes for; each model adds one column to the same rows."""
    rows = df
    total, score = 0.0, F.lit(0.0)
    for name, (model, weight) in models.items():
        passed = model.transform(rows)
        rows = passed.select(*rows.columns, F.col("prediction").cast("int").alias(f"pred_{name}"))
        score = score + F.col(f"pred_{name}") * F.lit(float(weight))
        total += weight
    return rows.withColumn(out, (score > total / 2).cast("int"))


def numeric_preprocess(
    df: DataFrame, columns: Sequence[str], log: float | str | None = None, center: bool = False, scale: bool = False,
    impute: str | float = "mean", flags: bool = False,
) -> DataFrame:
    """Logarithm, then scaling, then imputation, in that order; optional missing flags.

    All figures of a step come from one aggregate. ``impute`` is ``mean``, ``median``,
    ``most_frequent`` (smallest on ties) or a constant in scaled units.
    """
    from tallyhouse.operators.bins import log_plus

    marks = {f"missing_{c}": F.col(c).isNull().cast("int") for c in columns} if flags else {}
    rows = df.withColumns(marks) if marks else df
    if log is not None:
        rows = log_plus(rows, columns, log)
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    get = lambda n: stats.select(n).scalar()
    scaled = {}
    for c in columns:
        v = F.col(c).cast("double")
        if center:
            v = v - get(f"m_{c}")
        if scale:
            s = get(f"s_{c}")
            v = v / F.when(s == 0, 1.0).otherwise(s)
        scaled[c] = v
    rows = rows.withColumns(scaled)
    filled = {}
    for c in columns:
        if isinstance(impute, (int, float)):
            fill: Column = F.lit(float(impute))
        elif impute == "mean":
            fill = rows.agg(F.avg(c)).scalar()
        elif impute == "median":
            fill = exact_quantiles(rows.select(F.lit(1).alias("_g"), c), ["_g"], c, {"q": 0.5}).select("q").scalar()
        elif impute == "most_frequent":
            counts = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            fill = counts.agg(F.max(F.struct("n", (-F.col(c)).alias("v"))).alias("m")).select(-F.col("m.v")).scalar()
        else:
            raise ValueError(impute)
        filled[c] = F.coalesce(F.col(c), fill)
    return rows.withColumns(filled)


def grid_search(
    df: DataFrame, pipeline: Pipeline, grid: Mapping, evaluator: Evaluator, folds: int, key: str, seed: int | str, parallelism: int = 4
) -> DataFrame:
    """Mean and deviation of a score over folds for each parameter set, best first.

    Folds come from the row key, so they do not depend on the partitioning. Rows are computed once and stored, as every fold reads them.
    """
    stored = kept_table(df.withColumn("_fold", F.floor(uniform(seed, key) * folds).cast("int")), "folds")
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, values)
    maps = builder.build()
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, foldCol="_fold"
    )
    fitted = cv.fit(stored)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in m.items()), float(a), float(s))
        for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "params STRING, mean DOUBLE, deviation DOUBLE").orderBy(F.col("mean").desc())


def learning_curve(
    train: DataFrame, validation: DataFrame, pipeline: Estimator, label: str, key: str, steps: int, seed: int | str
) -> DataFrame:
    """Accuracy on training and validation rows for growing nested training sets, one fit per size."""
    spark = train.sparkSession
    rows = train.withColumn("_u", uniform(seed, key)).persist()
    out = []
    for i in range(1, steps + 1):
        part = rows.where(F.col("_u") <= i / steps)
        fitted = pipeline.fit(part)
        score = lambda d: binary_metrics(
            fitted.transform(d).withColumn("_p", F.col("prediction").cast("int")), label, "_p").first()["accuracy"]
        out.append((i, part.count(), float(score(part)), float(score(validation))))
    rows.unpersist()
    return spark.createDataFrame(out, "step INT, n_train LONG, train DOUBLE, validation DOUBLE")


def text_clusters(
    df: DataFrame, text: str, k: int, components: int, key: str, min_df: int = 4, max_df: float = 0.95, stopwords: Sequence[str] = (), seed: int = 7
) -> DataFrame:
    """Cluster of each text and the weight 1 / cluster size.

    TF-IDF over all words that are neither rare nor nearly everywhere, projected on its first singular vectors
    (not centred), then k-means. Texts without such a word lie at the origin. ``key`` is unique.
    """
    words = tokens(F.col(text))
    words = F.filter(words, lambda t: ~t.isin(*stopwords)) if stopwords else words
    counts = word_blocks(df, key, words)
    placed, values = truncated_svd(tf_idf(counts, key, min_df=min_df, max_df=max_df), key, "token", components)
    names = [f"z{i}" for i in range(len(values))]
    full = df.select(key).join(placed, key, "left").fillna(0.0, subset=names)
    points = full.select(key, array_to_vector(F.array(*names)).alias("_pc")).persist(StorageLevel.MEMORY_AND_DISK)
    model = KMeans(k=k, featuresCol="_pc", predictionCol="cluster_id", seed=seed).fit(points)
    out = df.join(model.transform(points).select(key, "cluster_id"), key)
    sizes = out.groupBy("cluster_id").agg((1.0 / F.count(F.lit(1))).alias("cluster_weight"))
    return out.join(sizes, "cluster_id").select(*df.columns, "cluster_id", "cluster_weight")


def account_validator(
    train: DataFrame, accounts: DataFrame, label: str, numbers: Sequence[str], text: str, words: int = 1 << 16, trees: int = 100, seed: int = 7
) -> DataFrame:
    """Accounts a random forest on account figures and description words takes for genuine.

    Every word of the training descriptions is a feature, up to the ``words`` most frequent ones.
    """
    tf = CountVectorizer(inputCol="tokens", outputCol="_tf", vocabSize=words)
    join = VectorAssembler(inputCols=[*numbers, "_tf"], outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed)
    model = Pipeline(stages=[tf, join, forest]).fit(with_tokens(train, text))
    judged = model.transform(with_tokens(accounts, text))
    return judged.where("prediction = 1").select(*accounts.columns)


def default_scorer(train: DataFrame, label: str, text: str = "text") -> PipelineModel:
    """Scorer shipped with the library: logistic regression on hashed words."""
    return text_classifier("logistic", label, regParam=0.01, maxIter=30).fit(with_tokens(train, text))


def area_under_roc(label: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
