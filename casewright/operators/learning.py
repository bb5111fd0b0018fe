"""Detectors as Spark ML pipelines, and checks of their scores; ``boosting`` has the many-class model over sparse vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, FeatureHasher, VarianceThresholdSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import checkpoint_dir, spread, stored

from .metrics import percentiles

#: Buckets of a number, as many as Spark's trees make by themselves; lots that rows alike are counted in; counts for each task.
BUCKETS, LOTS, ROWS_A_TASK = 32, 16, 50_000


@dataclass(frozen=True)
class Detector:
    """Gradient-boosted trees for two classes over buckets of numbers and hashed texts.

    Trees see a number by its quantile bucket only, so training rows alike in buckets, texts and label are counted, all
    of them, and the trees are grown from the counts: their many passes don't grow with the rows. Counts are kept
    in lots by the hash of a unique ``key``, so that a round's sample leaves out a share of rows alike and not all of them.
    """

    columns: list[str]
    key: str
    label: str
    trees: int
    depth: int
    seed: int

    def fit(self, rows: DataFrame) -> PipelineModel:
        checkpoint_dir(rows.sparkSession)  # boosting cuts its lineage there
        numbers = [c for c, kind in rows.dtypes if c in self.columns and kind not in ("string", "boolean")]
        buckets = self._buckets(rows, numbers)
        names = [f"{c}_bucket" if c in numbers else c for c in self.columns]
        counted = self.counted(buckets.transform(rows), names)
        hasher = FeatureHasher(inputCols=names, outputCol="hashed", numFeatures=256)
        varying = VarianceThresholdSelector(featuresCol="hashed", outputCol="features", varianceThreshold=0.0)  # no split can be made on the others
        model = GBTClassifier(labelCol=self.label, featuresCol="features", weightCol="weight", maxIter=self.trees, maxDepth=self.depth, maxBins=2 * BUCKETS, stepSize=0.1, subsamplingRate=0.8, seed=self.seed)
        return PipelineModel([buckets, *Pipeline(stages=[hasher, varying, model]).fit(counted).stages])

    def counted(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """label, ``names``, lot and weight: how many rows are alike, in an order of their own, so that samples come out the same again."""
        same = [self.label, *names, "lot"]
        counts = rows.withColumn("lot", F.pmod(F.xxhash64(self.key), F.lit(LOTS))).groupBy(*same).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        counts = stored(counts, "alike-rows")
        # A few tasks where counts are few: there are thousands of passes, and each costs something by the task.
        tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + counts.count() // ROWS_A_TASK)
        return counts.repartition(tasks, *same).sortWithinPartitions(*same)

    def _buckets(self, rows: DataFrame, numbers: list[str]) -> Bucketizer:
        """Cuts at exact quantiles; a missing number has a bucket of its own."""
        values = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numbers)))).select("col.*").where(~F.isnan("v")) if numbers else None
        cuts = {r["name"]: r.q for r in percentiles(values, ["name"], "v", [k / BUCKETS for k in range(1, BUCKETS)]).collect()} if numbers else {}  # one row for each column
        ends = float("inf")
        splits = [[-ends, *(sorted({q for q in cuts.get(c, [0.0]) if abs(q) < ends}) or [0.0]), ends] for c in numbers]
        return Bucketizer(splitsArray=splits, inputCols=numbers, outputCols=[f"{c}_bucket" for c in numbers], handleInvalid="keep")


def detector(columns: list[str], label: str = "label", key: str = "doc_id", trees: int = 300, depth: int = 6, seed: int = 42, estimator: Estimator | None = None) -> Detector | Pipeline:
    """Gradient-boosted trees for two classes, as many and as deep as the original's; any other estimator, over hashed features, can take their place."""
    if estimator is None:
        return Detector(columns, key, label, trees, depth, seed)
    return Pipeline(stages=[FeatureHasher(inputCols=columns, outputCol="features", numFeatures=256), estimator])


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Training rows over all tasks, in the order of a unique key, so that no task holds most of them and samples come out the same again."""
    return spread(rows, key).sortWithinPartitions(key)


def scored(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the probability of class 1."""
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("probability"))


def check_scores(rows: DataFrame, column: str = "probability") -> DataFrame:
    """Rows whose score is missing, not finite or out of range: there must be none."""
    p = F.col(column)
    return rows.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
