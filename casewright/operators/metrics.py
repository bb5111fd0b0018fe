"""Grouped classification metrics as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.session import stored

from . import radix

from .campaign import safe_ratio

GRAY = (0.4, 0.6)


def binary_metrics(rows: DataFrame, *by: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, f1 and specificity, 0.0 on empty denominators."""
    t, p = F.col(truth), F.col(pred)
    counts = {"tp": F.count_if(t & p), "tn": F.count_if(~t & ~p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p)}
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(*(v.alias(k) for k, v in counts.items()))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    return out.withColumns({"accuracy": safe_ratio(tp + tn, tp + tn + fp + fn), "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "specificity": safe_ratio(tn, tn + fp), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn)})


def selective_metrics(rows: DataFrame, *by: str, prob: str = "prob", low: float = GRAY[0], high: float = GRAY[1]) -> DataFrame:
    """Binary metrics of the rows outside the gray zone (both ends abstain), with coverage."""
    gray = F.col(prob).between(low, high)
    sides = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.count_if(gray).alias("n_abstained"), F.count_if(gray & F.col("truth")).alias("n_abstained_attack"))
    decided = binary_metrics(rows.where(~gray), *by)
    joined = sides.join(decided, list(by)) if by else sides.crossJoin(decided)  # one row each
    return joined.withColumn("coverage", safe_ratio(F.col("n") - F.col("n_abstained"), F.col("n")))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame, labels: tuple[str, ...], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """precision, recall, f1 and support of every declared label, absent ones with zeros."""
    spark: SparkSession = rows.sparkSession
    cells = confusion(rows, truth, pred)
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hit"))
    space = spark.createDataFrame([(x,) for x in labels], "label string").coalesce(1)
    out = space.join(sums, "label", "left").na.fill(0)
    return out.select("label", "support", safe_ratio(F.col("hit"), F.col("predicted")).alias("precision"), safe_ratio(F.col("hit"), F.col("support")).alias("recall"), safe_ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"))


def macro_metrics(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Accuracy, macro and weighted means over the declared labels."""
    per = class_metrics(rows, labels)
    macro = per.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), safe_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    return macro.crossJoin(rows.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy")))  # one row each


def risk_coverage(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Coverage and risk of the rows at or above a confidence; risk is null if there are none."""
    decided = F.col("conf") >= threshold
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.count_if(decided).alias("n_decided"), F.count_if(decided & (F.col("truth") != F.col("pred"))).alias("n_wrong"))
    return out.withColumn("coverage", safe_ratio(F.col("n_decided"), F.col("n"))).withColumn("risk", F.try_divide(F.col("n_wrong").cast("double"), F.col("n_decided").cast("double")))


def threshold_sweep(rows: DataFrame, steps: int = 100) -> DataFrame:
    """Coverage and risk at 0.00, 0.01, ... in one pass: counts by hundredth, then sums from above.

    Rows are first summed by the highest step that they still pass, so the grid
    never multiplies them.
    """
    step = F.least(F.floor(F.col("conf") * steps + 1e-9), F.lit(steps - 1)).cast("bigint")
    bins = rows.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") != F.col("pred")).alias("wrong"))
    grid = rows.sparkSession.range(0, steps, 1, 1).select(F.col("id").alias("k")).join(bins, "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k"))  # a grid of ``steps`` rows
    sums = grid.select("k", F.sum("n").over(above).alias("n_decided"), F.sum("wrong").over(above).alias("n_wrong"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("n"))
    return sums.select("k", "n_decided", "n_wrong", safe_ratio(F.col("n_decided"), F.col("n")).alias("coverage"), F.try_divide(F.col("n_wrong").cast("double"), F.col("n_decided").cast("double")).alias("risk"))


def threshold_choice(sweep: DataFrame, max_risk: float, min_coverage: float) -> DataFrame:
    """The feasible step with the greatest coverage (then least risk, then lowest step), else the one with the least risk."""
    fit = (F.col("risk") <= max_risk) & F.col("risk").isNotNull()
    usable = sweep.where((F.col("coverage") >= min_coverage) & F.col("risk").isNotNull())
    order = [F.desc(fit), F.when(fit, -F.col("coverage")).otherwise(F.col("risk")), F.when(fit, F.col("risk")).otherwise(-F.col("coverage")), F.col("k")]
    return usable.orderBy(*order).limit(1).withColumn("feasible", fit)


def top_k(scores: Column, k: int) -> Column:
    """The k entries (label, score) of an array with the highest scores; ties keep their order."""
    numbered = F.transform(scores, lambda s, i: F.struct((-s["score"]).alias("neg"), i.alias("place"), s["label"].alias("label"), s["score"].alias("score")))
    return F.transform(F.slice(F.array_sort(numbered), 1, k), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; one set of keys is left."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*(f"_r_{k}" for k in keys))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float], most: int = 65_536) -> DataFrame:
    """(by, q): exact percentiles of each group, interpolated at (n - 1) * share; nulls don't count.

    Equal values are counted first. Where no group has more than ``most`` distinct
    values a running sum over its counts tells the wanted places; else they are found by
    radix over the order-preserving bits of the values, so that no task sorts a large group,
    however its values are spread. Groups without a value have no row.
    """
    v = F.col("_v")
    counts = stored(rows.select(*by, F.col(value).cast("double").alias("_v")).where(v.isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "percentile-counts")
    facts = counts.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_distinct"))
    places = F.array_distinct(F.array(*(f((F.col("_all") - 1) * F.lit(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil))))
    wanted = facts.select(*by, "_all", F.explode(places).alias("_place"))
    if (facts.agg(F.max("_distinct")).first()[0] or 0) <= most:
        upto = F.sum("_n").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_v"))
        ranges = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
        at = _met(wanted, ranges, by).where((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to")))
    else:
        from_top = wanted.select(*by, (F.col("_all") - F.col("_place")).alias("place"))
        bits = counts.select(*by, "_n", radix.ordered_bits("_v").alias("_b"))
        found = radix.kth(bits, by, "_b", from_top, "_n").select(*by, "place", radix.from_bits("_b").alias("_v"))
        at = _met(facts.select(*by, "_all"), found, by).withColumn("_place", F.col("_all") - F.col("place"))
    # two places for each share
    listed = at.groupBy(*by).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_m"))

    def between(share: float) -> Column:
        exact = (F.col("_all") - 1) * F.lit(share)
        low, high = F.col("_m")[F.floor(exact)], F.col("_m")[F.ceil(exact)]
        return low + (high - low) * (exact - F.floor(exact))

    return listed.select(*by, F.array(*(between(s) for s in shares)).alias("q"))


def confidence_summary(rows: DataFrame, *by: str, value: str = "conf") -> DataFrame:
    """Mean, least, 5th percentile, median, 95th percentile and greatest value, interpolated."""
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = percentiles(rows, list(by), value, [0.05, 0.5, 0.95])
    return _met(out, q, list(by), "left").select(*by, "n", "mean", "lo", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "hi")


def majority_baseline(train: DataFrame, test: DataFrame, by: str, label: str) -> DataFrame:
    """Test rows with the majority label of their group in training, else that of all; ties take the smallest label."""
    counts = train.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    pick = lambda frame, *keys: frame.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("guess"))
    whole = pick(train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))).select(F.col("guess").alias("fallback"))
    return test.join(pick(counts, by), by, "left").crossJoin(whole).withColumn("pred", F.coalesce("guess", "fallback")).drop("guess", "fallback")  # one row
