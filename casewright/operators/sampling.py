"""Seeded, order-independent selections: quotas, balance, splits and rounding.

All randomness is the rank of a seeded SHA-256. Ranks inside a large group come
from ``ranked``: the hash's first digits cut a group into buckets, whose sizes
are summed before rows are numbered inside each bucket, so that no group is
sorted in one task.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def ranked(rows: DataFrame, by: list[str], order: Column, tie: str, digits: int = 2) -> DataFrame:
    """Adds ``rn``: the place of each row in its group by ``order`` (a hexadecimal hash), then ``tie``."""
    rows = rows.withColumn("_h", order).withColumn("_b", F.left("_h", F.lit(digits)))
    sizes = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", tie))
    return rows.withColumn("_k", inside).join(starts, [*by, "_b"]).withColumn("rn", (F.col("_start") + F.col("_k")).cast("bigint")).drop("_h", "_b", "_k", "_start")


def balance_binary(rows: DataFrame, seed: str, by: tuple[str, ...] = ("split", "origin"), label: str = "is_attack", key: str = "manifest_id") -> DataFrame:
    """As many rows of either label in each cell as the rarer one has, by seeded rank."""
    cells = rows.groupBy(*by).agg(F.least(F.count_if(F.col(label)), F.count_if(~F.col(label))).alias("quota"))
    return ranked(rows, [*by, label], seeded(seed, F.col(key)), key).join(cells, list(by)).where("rn <= quota").drop("quota")


def balance_check(rows: DataFrame, by: tuple[str, ...] = ("split", "origin"), label: str = "is_attack") -> DataFrame:
    """Whether the labels balance at every level of ``by``."""
    return rows.cube(*by).agg((F.count_if(F.col(label)) * 2 == F.count(F.lit(1))).alias("balanced"), F.count(F.lit(1)).alias("n"))


def hamilton(counts: DataFrame, by: list[str], name: str, target: Column, seed: str) -> DataFrame:
    """Largest-remainder shares: (by, name, quota) of ``target`` in proportion to ``n``.

    What rounding down leaves goes to the largest remainders, ties by seeded hash and name.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    exact = counts.withColumn("goal", target.cast("bigint")).withColumn("total", F.sum("n").over(group))
    exact = exact.withColumn("base", F.floor(F.col("goal") * F.col("n") / F.col("total")).cast("bigint"))
    exact = exact.withColumn("rem", F.col("goal") * F.col("n") - F.col("base") * F.col("total"))
    exact = exact.withColumn("left_over", F.col("goal") - F.sum("base").over(group))
    order = group.orderBy(F.desc("rem"), seeded(seed, F.col(name)), name)
    return exact.withColumn("rn", F.row_number().over(order)).select(*by, name, "n", (F.col("base") + F.when(F.col("rn") <= F.col("left_over"), 1).otherwise(0)).cast("bigint").alias("quota"))


def proportional_sample(rows: DataFrame, goal: int, levels: tuple[str, str], seed: str, key: str) -> DataFrame:
    """``goal`` rows in proportion to the nested levels, by seeded rank inside the inner one."""
    outer, inner = levels
    top = hamilton(rows.groupBy(outer).agg(F.count(F.lit(1)).alias("n")), [], outer, F.lit(goal), seed).select(outer, F.col("quota").alias("above"))
    counts = rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n")).join(top, outer)
    quotas = hamilton(counts, [outer], inner, F.col("above"), seed).select(outer, inner, "quota")
    return ranked(rows, [outer, inner], seeded(seed, F.col(key)), key).join(quotas, [outer, inner]).where("rn <= quota").drop("quota")


def stratified_split(rows: DataFrame, by: str, seed: str, key: str) -> DataFrame:
    """70, 15 and the remaining percent of each class: floors, so that what is left goes to test."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    first, second = F.floor(F.col("n") * 70 / 100), F.floor(F.col("n") * 15 / 100)
    part = F.when(F.col("rn") <= first, "train").when(F.col("rn") <= first + second, "val").otherwise("test")
    return ranked(rows, [by], seeded(seed, F.col(key)), key).join(n, by).select(by, key, part.alias("part"))


def round_robin(rows: DataFrame, by: str, goal: int, seed: str, key: str) -> DataFrame:
    """``goal`` rows, taken from the classes in turn: every class's first, then every class's second, and so on."""
    placed = ranked(rows, [by], seeded(seed, F.col(key)), key)
    return placed.orderBy("rn", by).limit(goal).select(by, key, "rn")


def distinct_class_sample(rows: DataFrame, by: str, content: str, quota: int, seed: str, key: str) -> DataFrame:
    """Up to ``quota`` distinct contents of each class, the first row of each, by seeded rank."""
    first = rows.groupBy(by, content).agg(F.min(key).alias(key))
    return ranked(first, [by], seeded(seed, F.col(content)), content).where(F.col("rn") <= quota)


def balanced_view(rows: DataFrame, origin: str, label: str, least: int, seed: str, key: str) -> DataFrame:
    """In each origin the classes with at least ``least`` rows, each cut to the rarest of them."""
    counts = rows.groupBy(origin, label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    quotas = counts.withColumn("quota", F.min("n").over(Window.partitionBy(origin))).drop("n")
    return ranked(rows, [origin, label], seeded(seed, F.col(key)), key).join(quotas, [origin, label]).where("rn <= quota").drop("quota")


SPLITS = ("train", "val", "test")
#: Units of an exact split, 14 : 3 : 3.
UNITS = (14, 3, 3)


def _tie(seed: str, row: str, column: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{row}|{column}".encode()).digest()[:8], "big")


def round_matrix(counts: dict[str, int], seed: str) -> dict[str, tuple[int, ...]]:
    """Whole numbers near count * unit / 20 for each row, with exact row sums and column sums.

    Column sums are the shares of the whole by largest remainders. Rows are taken in order of
    their names; a table over the columns' remaining deficits keeps the greatest
    sum of remainders that were rounded up, ties by seeded hash.
    """
    names = sorted(counts)
    total = sum(counts.values())
    exact = {n: [Fraction(counts[n] * u, sum(UNITS)) for u in UNITS] for n in names}
    floors = {n: [int(x) for x in exact[n]] for n in names}
    goal = [total * u // sum(UNITS) for u in UNITS]
    for j in sorted(range(3), key=lambda j: (-(total * UNITS[j] % sum(UNITS)), j))[: total - sum(goal)]:
        goal[j] += 1
    need = tuple(goal[j] - sum(floors[n][j] for n in names) for j in range(3))
    state: dict[tuple[int, ...], tuple[Fraction, int, tuple]] = {need: (Fraction(0), 0, ())}
    for n in names:
        ups = counts[n] - sum(floors[n])
        choices = [c for c in ((a, b, d) for a in (0, 1) for b in (0, 1) for d in (0, 1)) if sum(c) == ups]
        following: dict[tuple[int, ...], tuple[Fraction, int, tuple]] = {}
        for left, (gain, tie, path) in state.items():
            for c in choices:
                rest = tuple(a - b for a, b in zip(left, c, strict=True))
                if min(rest) < 0:
                    continue
                value = gain + sum((exact[n][j] - floors[n][j] for j in range(3) if c[j]), Fraction(0))
                score = tie + sum(_tie(seed, n, SPLITS[j]) for j in range(3) if c[j])
                if rest not in following or (value, score) > following[rest][:2]:
                    following[rest] = (value, score, (*path, c))
        state = following
    best = state.get((0, 0, 0))
    if best is None:
        raise ValueError("no rounding meets all row and column sums")
    return {n: tuple(f + u for f, u in zip(floors[n], c, strict=True)) for n, c in zip(names, best[2], strict=True)}


def split_matrix(counts: DataFrame, by: str, name: str, seed: str) -> DataFrame:
    """(by, name, part, quota) of controlled rounding for each group of a small table of counts (by, name, n)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = round_matrix(dict(zip(group[name].astype(str), group["n"].astype(int), strict=True)), seed)
        return pd.DataFrame([(group[by].iloc[0], row, part, q) for row, values in found.items() for part, q in zip(SPLITS, values, strict=True)], columns=[by, name, "part", "quota"])

    return counts.groupBy(by).applyInPandas(run, f"{by} string, {name} string, part string, quota long")


def exact_split(rows: DataFrame, by: str, name: str, seed: str, key: str) -> DataFrame:
    """Every row with its ``part``, so that each (by, name) cell meets the rounded quotas exactly."""
    quotas = split_matrix(rows.groupBy(by, name).agg(F.count(F.lit(1)).alias("n")), by, name, seed)
    wide = quotas.groupBy(by, name).agg(*(F.sum(F.when(F.col("part") == p, F.col("quota"))).alias(p) for p in SPLITS))
    placed = ranked(rows, [by, name], seeded(seed, F.col(key)), key).join(wide, [by, name])
    part = F.when(F.col("rn") <= F.col("train"), "train").when(F.col("rn") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return placed.select(by, name, key, part.alias("part"))


def selection_hash(rows: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """n and one ``sha`` of a selection's keys, whatever their order.

    Keys are hashed in 16 ** ``digits`` buckets by their own hash; the buckets'
    hashes, in order, make the last one.
    """
    text = F.col(key).cast("string")
    buckets = rows.groupBy(F.left(F.sha2(text, 256), F.lit(digits)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.expr(f"listagg(CAST({key} AS STRING), ',') WITHIN GROUP (ORDER BY {key})"), 256).alias("h"))
    return buckets.agg(F.sum("n").alias("n"), F.sha2(F.expr("listagg(concat(b, ':', h), ',') WITHIN GROUP (ORDER BY b)"), 256).alias("sha"))
