import numpy as np
import pytest
from tidewave.operators import learning


def test_models_recover_their_parameters(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 2))
    mean = np.exp(0.3 + x @ [0.5, -0.2])
    rows = [(i, float(a), float(b), float(1 + 2 * a - b), float(rng.poisson(m)), float(rng.random() < 1 / (1 + np.exp(-3 * a)))) for i, ((a, b), m) in enumerate(zip(x, mean, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, n double, z double")
    linear = learning.fit_glm(df, ["a", "b"], "y").transform(df)
    assert max(abs(r.prediction - r.y) for r in linear.select("prediction", "y").collect()) < 1e-6
    poisson = learning.fit_glm(df, ["a", "b"], "n", "poisson").transform(df).select("prediction").toPandas().prediction
    assert np.corrcoef(poisson, mean)[0, 1] > 0.98
    bern = learning.fit_glm(df, ["a", "b"], "z", "bernoulli").transform(df).select("prediction", "z").toPandas()
    assert (bern.prediction == bern.z).mean() > 0.8


def test_folds_and_balance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 5 == 0), float(rng.normal() + 3 * (i % 5 == 0))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label double, a double")
    sizes = {(r.label, r.fold): r["count"] for r in learning.folded(df, 4, "label").groupBy("label", "fold").count().collect()}
    assert set(sizes.values()) == {40, 10}
    n = {r.label: r["count"] for r in learning.balanced(df, "label").groupBy("label").count().collect()}
    assert n == {0.0: 160, 1.0: 160}
    assert all(f1 > 0.8 for f1, _ in learning.cross_validated(df, ["a"], "label", 2, 5))


def test_largest_difference(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "g int, v double")
    assert learning.kolmogorov_smirnov(df, "v", "g").first().d == pytest.approx(0.5)
