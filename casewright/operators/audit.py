"""System audit: named assertions over the outputs of components, and a semaphore for each component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, hard, what must hold, share of failures that a soft check bears.
Check = tuple[str, bool, Column, float]


def assertions(component: str, outputs: DataFrame, checks: list[Check]) -> DataFrame:
    """component, check_name, hard, n, n_failed and ``broken`` of every check, all in one pass over ``outputs``; unknown counts as failed.

    A hard check bears no failure and needs at least one row.
    """
    failed = [F.count_if(~F.coalesce(holds, F.lit(False))).alias(f"_f{k}") for k, (_, _, holds, _) in enumerate(checks)]
    found = outputs.agg(F.count(F.lit(1)).alias("n"), *failed)
    entries = []
    for k, (name, hard, _, share) in enumerate(checks):
        broken = (F.col(f"_f{k}") > 0) | (F.col("n") == 0) if hard else F.col(f"_f{k}") > F.col("n") * F.lit(share)
        entries.append(F.struct(F.lit(name).alias("check_name"), F.lit(hard).alias("hard"), F.col(f"_f{k}").alias("n_failed"), broken.alias("broken")))
    return found.select(F.lit(component).alias("component"), "n", F.explode(F.array(*entries)).alias("e")).select("component", "e.check_name", "e.hard", "n", "e.n_failed", "e.broken")


def audited(*parts: DataFrame) -> DataFrame:
    """All assertions with their component's semaphore: red if a hard check is broken, amber if a soft one is, else green."""
    every = reduce(DataFrame.unionByName, parts)
    worst = every.groupBy("component").agg(F.bool_or(F.col("broken") & F.col("hard")).alias("_red"), F.bool_or("broken").alias("_amber"))
    light = F.when(F.col("_red"), "red").when(F.col("_amber"), "amber").otherwise("green")
    return every.join(worst, "component").select(*every.columns, light.alias("semaphore"))
