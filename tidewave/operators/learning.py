"""Linear models and classifiers by Spark ML, and what goes before and after them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_glm(df: DataFrame, features: list[str], target: str, family: str = "gaussian", penalty: float = 0.0, mix: float = 0.0) -> PipelineModel:
    """A model of the target: gaussian (elastic net), poisson (log link) or bernoulli. Features are scaled inside, so prediction scales alike."""
    model = {
        "gaussian": lambda: LinearRegression(labelCol=target, regParam=penalty, elasticNetParam=mix),
        "poisson": lambda: GeneralizedLinearRegression(labelCol=target, family="poisson", link="log", regParam=penalty),
        "bernoulli": lambda: LogisticRegression(labelCol=target, regParam=penalty, elasticNetParam=mix),
    }[family]()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model]).fit(df)


def folded(df: DataFrame, folds: int, label: str, seed: int = 0, parts: int = 256) -> DataFrame:
    """Adds fold: each label's rows, shuffled by a hash of their id, are dealt in turn.

    A label's rows are numbered in parts of the range of hashes, so that no
    task sorts a label whole. Null labels count as one.
    """
    h = F.xxhash64(F.col("id"), F.lit(seed))
    rows = df.withColumn("_part", F.shiftright(h, 64 - (parts - 1).bit_length())).withColumn("_key", F.coalesce(F.col(label).cast("string"), F.lit("\x00")))
    before = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(h, "id")) - 1
    return rows.withColumn("_place", place).join(before, ["_key", "_part"]).withColumn("fold", ((F.col("_place") + F.col("_before")) % folds).cast("int")).drop("_key", "_part", "_place", "_before")


def balanced(df: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Rows of the smaller labels repeated, so that each label has about as many as the largest."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    most = n.agg(F.max("_n").alias("_most"))
    ratio = df.join(F.broadcast(n.join(F.broadcast(most)).select(label, (F.col("_most") / F.col("_n")).alias("_r"))), label)
    extra = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0 < F.col("_r") - F.floor("_r")
    times = F.floor("_r") + F.when(extra, 1).otherwise(0)
    return ratio.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("_r", "_k")


def cross_validated(df: DataFrame, features: list[str], label: str, folds: int = 5, trees: int = 50, seed: int = 0) -> list[tuple[float, float]]:
    """(f1, accuracy) of a forest on each fold, trained on the others with balanced labels. df has an id."""
    dealt = folded(df, folds, label, seed)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    out = []
    for k in range(folds):
        forest = RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)
        model = forest.fit(assembler.transform(balanced(dealt.filter(F.col("fold") != k), label, seed)))
        scored = model.transform(assembler.transform(dealt.filter(F.col("fold") == k)))
        e = MulticlassClassificationEvaluator(labelCol=label)
        out.append((e.evaluate(scored, {e.metricName: "f1"}), e.evaluate(scored, {e.metricName: "accuracy"})))
    return out


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, parts: int = 200) -> DataFrame:
    """d: the largest difference of the two groups' (0 and 1) cumulative shares of a value.

    Values are cut at approximate quantiles into parts that are summed up by
    themselves and moved on by the parts before, so no task sees all values.
    """
    n = df.groupBy().agg(F.count_if(F.col(group) == 0).alias("n0"), F.count_if(F.col(group) == 1).alias("n1"))
    edges = sorted(set(df.approxQuantile(value, [k / parts for k in range(1, parts)], 1 / (4 * parts))))
    part = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>"), lambda e: e < F.col(value)))
    steps = df.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    steps = steps.withColumnRenamed("v", value).filter(F.col(value).isNotNull()).withColumn("part", part)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the parts, of which there are few
    before = steps.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("part", F.coalesce(F.sum("a").over(ahead), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"))
    w = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select("part", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b")).join(F.broadcast(before), "part")
    return summed.join(F.broadcast(n)).select(F.abs((F.col("a") + F.col("a0")) / F.col("n0") - (F.col("b") + F.col("b0")) / F.col("n1")).alias("x")).agg(F.max("x").alias("d"))
