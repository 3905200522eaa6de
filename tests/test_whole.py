"""Queries that look at every row."""

import numpy as np
from pyspark.sql import functions as F
from tidewave.plans import registry, studies


def test_every_point_is_a_query(spark, tmp_path):
    # of no id that 50 divides
    rng = np.random.default_rng(5)
    rows = [(50 * i + 1, i % 2, rng.normal(4 * (i % 2), 1, 64).tolist()) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.label: (r.hit, r.miss) for r in registry.q_knn_hit_miss(spark, str(tmp_path)).collect()}
    assert got == {0: (1.0, 0.0), 1: (1.0, 0.0)}


def test_neighbourhoods_take_every_point_as_a_query(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("vec_id", F.col("vec_id") * 50 + 1).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = studies.q_neighbourhood_hits(spark, str(tmp_path)).collect()
    assert rows and all(r.hit is not None for r in rows)
