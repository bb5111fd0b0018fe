"""Mixing sources to target weights, by hierarchical budgeting.

The corpus is a tree of domains, languages and sources. A token budget goes
from the root to the leaves by weight; a node never gets more than what its
subtree can give (its tokens times ``max_epochs``), and what a node can't use
goes to its siblings in proportion to their weights before anything is left to
its parent's siblings. Each level is solved in closed form by windows over the
tree, which is small; documents are only aggregated.

A leaf with budget b and t tokens takes every document b div t times, and b mod
t further tokens as a prefix of one more epoch: the documents in the order of a
seeded hash, as long as their running sum of tokens fits. The running sum is
split by the first hexadecimal digits of the hash: sums by bucket, a running
sum over the buckets of a leaf, and a running sum inside each bucket. So a leaf
with a third of all rows is spread over 16 ** ``digits`` pieces.

Defined results: null text has no words and is never drawn in a partial epoch
that has no room, but counts as fitting (0 tokens); null language or source is a
node of its own (``?``); repeated rows are separate documents; rows alike in doc_id,
hash and tokens are summed in no set order, so how many of them a prefix takes
is fixed, but not which of them, where they differ in other columns; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import stored

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: The production weights. Names that are not listed weigh ``OTHER``.
OTHER = 1
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "reference": 2}
LANG_WEIGHTS = {"en": 12, "fr": 4, "de": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
SEED = 17
MAX_EPOCHS = 3


def default_domain(source: Column) -> Column:
    """Domain of a source: by the last digit of its name."""
    last = F.regexp_extract(source, "([0-9])$", 1)
    return F.when(last.isin("0", "1", "2", "3", "4"), F.lit("web")).when(last.isin("5", "6", "7"), F.lit("books")).otherwise(F.lit("reference"))


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(OTHER)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("double")


def share_out(nodes: DataFrame, parents: list[str], key: str, weight: Column) -> DataFrame:
    """``nodes`` (parents, key, capacity, budget of the parent) with ``granted`` for each node.

    Siblings are ordered by capacity / weight. The level from which the
    remaining siblings can share what is left by weight sets the rate; those
    before it are full.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy("ratio", key)
    staged = nodes.withColumn("weight", weight).withColumn("ratio", F.col("capacity") / F.col("weight"))
    staged = staged.withColumns(
        {
            "full_before": F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_from": F.sum("weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("budget") - F.col("full_before")) / F.col("weight_from")
    staged = staged.withColumn("rate", F.max(F.when(level <= F.col("ratio"), level)).over(siblings))
    granted = F.when(F.col("rate").isNull() | (F.col("ratio") <= F.col("rate")), F.col("capacity")).otherwise(F.floor(F.col("rate") * F.col("weight") + 1e-6))
    return staged.withColumn("granted", granted.cast("long")).drop("weight", "ratio", "full_before", "weight_from", "rate", "budget")


def budgets(leaves: DataFrame, budget: Column | int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int], max_epochs: int) -> DataFrame:
    """domain, lang, source, available and ``granted`` tokens of every leaf (domain, lang, source, available)."""
    tree = leaves.withColumn("capacity", F.col("available") * max_epochs)
    weights = {"domain": domain_weights, "lang": lang_weights, "source": source_weights}
    above = None
    for depth, key in enumerate(LEVELS, 1):
        keys = list(LEVELS[:depth])
        nodes = tree.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        if above is None:
            total = tree.agg((F.floor(budget) if isinstance(budget, Column) else F.lit(budget)).cast("long").alias("budget"))
            nodes = nodes.join(F.broadcast(total), F.lit(True))  # one row
        else:
            nodes = nodes.join(above, keys[:-1])
        above = share_out(nodes, keys[:-1], key, _weight(key, weights[key])).select(*keys, F.col("granted").alias("budget"))
    return leaves.join(above, list(LEVELS)).withColumnRenamed("budget", "granted")


def mix(
    docs: DataFrame,
    budget: int | None = None,
    portion: float = 0.5,
    domain: Column | None = None,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] = SOURCE_WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    digits: int = 3,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and ``copies`` (1 or more) of every document that is drawn.

    The budget is ``budget`` tokens, or else ``portion`` of all tokens.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), *(F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("lang", "source")))
    # Words are counted once; all that follows reads this narrow table.
    own = stored(own.withColumn("domain", default_domain(F.col("source")) if domain is None else domain), "mix-tokens")
    leaves = own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"))
    goal = F.sum("available") * portion if budget is None else budget
    granted = budgets(leaves, goal, domain_weights, lang_weights, source_weights, max_epochs)
    full = F.when(F.col("available") > 0, F.floor(F.col("granted") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    # The plan and the sums are small and written out, so that what they are joined with isn't dealt by leaf.
    plan = granted.withColumn("full", full).withColumn("rest", F.col("granted") - F.col("full") * F.col("available")).select(*LEVELS, "full", "rest")
    plan = stored(plan, "mix-plan")
    ranked = own.join(plan, list(LEVELS)).withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col("full"), F.col("doc_id")), 256)).withColumn("bucket", F.substring("h", 1, digits))
    sums = ranked.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    earlier = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("before"))
    before = stored(before, "mix-sums")
    inside = Window.partitionBy(*LEVELS, "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranked.withColumn("inside", F.sum("n_tokens").over(inside)).join(before, [*LEVELS, "bucket"])
    copies = F.col("full") + F.when(F.col("before") + F.col("inside") <= F.col("rest"), 1).otherwise(0)
    return running.select("doc_id", "domain", "lang", "source", "n_tokens", copies.cast("long").alias("copies")).where("copies > 0")


def sql(portion: float = 0.5, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> str:
    """DuckDB SQL for ``mix`` with the production weights over ``documents``."""

    def case(column: str, weights: Mapping[str, int]) -> str:
        listed = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())
        return f"CAST(CASE {listed} ELSE {OTHER} END AS DOUBLE)" if listed else f"CAST({OTHER} AS DOUBLE)"

    steps = [
        f"""own AS (SELECT doc_id, n_tokens, lang, source, CASE WHEN d IN ('0','1','2','3','4') THEN 'web' WHEN d IN ('5','6','7') THEN 'books' ELSE 'reference' END AS domain FROM (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS BIGINT) AS n_tokens, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, regexp_extract(coalesce(source, '?'), '([0-9])$', 1) AS d FROM documents))""",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS available, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS capacity FROM own GROUP BY ALL)",
        f"b0 AS (SELECT CAST(floor(sum(available) * CAST({portion} AS DOUBLE)) AS BIGINT) AS budget FROM leaves)",
    ]
    for depth, (key, weights) in enumerate(zip(LEVELS, (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), strict=True), 1):
        keys = ", ".join(LEVELS[:depth])
        over = f"PARTITION BY {', '.join(LEVELS[: depth - 1])}" if depth > 1 else ""
        joined = f"JOIN b{depth - 1} USING ({', '.join(LEVELS[: depth - 1])})" if depth > 1 else "CROSS JOIN b0"
        steps += [
            f"n{depth} AS (SELECT *, capacity / weight AS ratio FROM (SELECT {keys}, budget, capacity, {case(key, weights)} AS weight FROM (SELECT {keys}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaves GROUP BY {keys}) {joined}))",
            f"o{depth} AS (SELECT *, coalesce(sum(capacity) OVER ({over} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(weight) OVER ({over} ORDER BY ratio, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM n{depth})",
            f"r{depth} AS (SELECT *, max(CASE WHEN (budget - full_before) / weight_from <= ratio THEN (budget - full_before) / weight_from END) OVER ({over}) AS rate FROM o{depth})",
            f"b{depth} AS (SELECT {keys}, CAST(CASE WHEN rate IS NULL OR ratio <= rate THEN capacity ELSE floor(rate * weight + 1e-6) END AS BIGINT) AS budget FROM r{depth})",
        ]
    steps += [
        "p AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN budget // available ELSE 0 END AS full_epochs, CASE WHEN available > 0 THEN budget % available ELSE budget END AS rest FROM leaves JOIN b3 USING (domain, lang, source))",
        f"k AS (SELECT own.*, full_epochs, rest, sha256('{seed}:' || full_epochs || ':' || doc_id) AS h FROM own JOIN p USING (domain, lang, source))",
        "c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM k)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c) WHERE copies > 0"
