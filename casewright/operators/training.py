"""Training of a detector from labelled rows: dedup, balance, checks, fit, metrics by group, and a stored model with its hash."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import stored
from casewright.sources import files

from . import campaign, learning, metrics, sampling


def prepared(rows: DataFrame, seed: str) -> DataFrame:
    """Rows (doc_id, fp, label, split, origin, ...) without leaks between splits or conflicts, with as many of either label in every split and origin."""
    kept = rows.join(campaign.dedup_labelled(rows), "doc_id", "left_semi")
    return sampling.balance_binary(kept, seed, label="label", key="doc_id").drop("rn")


def problems(rows: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """(problem, value) of prepared rows: labels that training lacks, fingerprints in more than one split. There must be none."""
    unseen = rows.groupBy(F.col(label).cast("string").alias("value")).agg(F.count_if(F.col(split) == "train").alias("n")).where("n = 0").select(F.lit("unseen_class").alias("problem"), "value")
    shared = rows.groupBy("fp").agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(F.lit("split_overlap").alias("problem"), F.col("fp").alias("value"))
    return unseen.unionByName(shared)


@dataclass
class Trained:
    model: PipelineModel
    scores: DataFrame  # doc_id, split, origin, truth, probability, pred


def train(rows: DataFrame, pipeline: Pipeline, seed: str = "42", threshold: float = 0.5) -> Trained:
    """Prepare, check, fit on the training split and score all splits; raises if a check finds something."""
    ready = stored(prepared(rows.withColumn("label", F.col("label").cast("boolean")), seed), "training-rows")
    found = problems(ready).limit(5).collect()
    if found:
        raise ValueError(f"rows can't be trained on: {[tuple(r) for r in found]}")
    numeric = ready.withColumn("label", F.col("label").cast("double"))
    model = pipeline.fit(learning.dealt(numeric.where("split = 'train'"), "doc_id"))
    scored = learning.scored(model, numeric, ["doc_id", "split", "origin", "label"])
    return Trained(model, scored.select("doc_id", "split", "origin", (F.col("label") == 1).alias("truth"), "probability", (F.col("probability") >= threshold).alias("pred")))


def report(trained: Trained) -> DataFrame:
    """Binary metrics of every split and origin."""
    return metrics.binary_metrics(trained.scores, "split", "origin")


def save(model: PipelineModel, path: str) -> DataFrame:
    """Store a model, replacing an older one, and give the hash of its files (sha256, n_files)."""
    model.write().overwrite().save(path)
    return files.inventory_hash(files.inventory(SparkSession.active(), path, recursive=True))


@lru_cache(maxsize=8)
def _loaded(path: str, sha256: str) -> PipelineModel:
    return PipelineModel.load(path)


def loaded(path: str) -> PipelineModel:
    """A stored model, read when it is first asked for and kept by the process as long as its files stay the same."""
    return _loaded(path, files.inventory_hash(files.inventory(SparkSession.active(), path, recursive=True)).first()["sha256"])
