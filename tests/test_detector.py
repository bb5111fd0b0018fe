"""The detector grows its whole forest, over counts of all training rows."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from casewright.operators import learning
from casewright.plans import registry


@pytest.mark.parametrize("name", ["ml_scores", "train_metrics"])
def test_queries_grow_as_many_trees_as_the_original(spark, data, monkeypatch, name):
    def fit(self, rows):
        raise StopAsyncIteration(self.getMaxIter(), self.getMaxDepth(), rows.agg(F.sum("weight")).first()[0])

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    with pytest.raises(StopAsyncIteration) as seen:
        registry.queries()[name](spark, data)
    trees, depth, weight = seen.value.args
    assert (trees, depth) == (300, 6)
    if name == "ml_scores":
        assert weight == spark.read.parquet(f"{data}/orders.parquet").count()


def test_odd_numbers_have_buckets_and_all_rows_count(spark):
    values = [float(k) for k in range(40)] + [None, float("nan"), float("inf"), -float("inf")]
    rows = spark.createDataFrame([(k, x, None if k % 5 == 0 else "ab"[k % 2], None, float(k % 40 > 20)) for k, x in enumerate(values)], "doc_id long, x double, t string, y double, label double")
    detector = learning.detector(["x", "t", "y"], trees=3, depth=2)
    model = detector.fit(rows)
    assert detector.counted(model.stages[0].transform(rows), ["x_bucket", "t", "y_bucket"]).agg(F.sum("weight")).first()[0] == len(values)
    scored = {r.doc_id: r.probability for r in learning.scored(model, rows, ["doc_id"]).collect()}
    assert len(scored) == len(values) and max(scored[k] for k in range(1, 20)) < min(scored[k] for k in range(22, 40))
    assert learning.check_scores(learning.scored(model, rows, ["doc_id"])).count() == 0
