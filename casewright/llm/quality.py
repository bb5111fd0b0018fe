"""Quality rules: robust multivariate outliers by language and source.

Every document is described by seven transformed statistics that vary in any
group of texts. For each cell (language and source) the minimum-covariance-determinant
estimate of location and scatter is found over all its documents: three robust
starts (distances from the coordinates' medians; the same turned by the scatter
of spatial signs; by the correlation of squashed coordinates) go through
concentration steps, in which the ``support`` share of documents with the least
Mahalanobis distances gives the next mean and covariance; the start with the
least determinant goes on until the determinant falls no more; one reweighted
step ends it. A step is a histogram of distances and one aggregation of moments,
both combined before they are shuffled: no group is ever gathered in one task,
and the result doesn't depend on how rows are dealt. Distances are told apart
in bins half a percent wide, so a core is made of whole bins.

A scatter is mixed with the corpus's variances only as far as its condition
number, relative to them, passes ``condition`` (the regularised form of the
estimate); ``ridge`` in the table of estimates says how far.

Documents of groups with fewer than ``min_group`` usable ones make up one cell
of their language; where that is too small as well, one cell of the corpus,
which is pooled with the cores of all others if it is still too small. A
document is rejected when its squared distance exceeds the quantile at
``confidence`` that it would have under a multivariate t distribution with
``dof`` degrees of freedom, since statistics of texts have heavier tails than
normal ones.

Defined results: null or empty text has zero counts and fails the base rule;
null language or source is a group value of its own; repeated rows are judged
one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import bounded_batches, stored

from . import textkit

#: The symbols that count, and the number of words below which a text fails.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct_words")
STATS = ("x_length", "x_word", "x_line", "x_upper", "x_other", "x_variety", "x_entropy")

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_POINT = np.ones(256, dtype=np.int64)
_POINT[0x80:0xC0] = 0


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _block_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of COUNTS for each text of a block."""
    n = len(offs) - 1
    starts, ends, rows = textkit.word_spans(buf, offs)
    values = textkit._RAW_VALUES[buf]
    hashes = textkit.span_hashes(values, starts, ends)
    out = np.zeros((n, len(COUNTS)), dtype=np.int64)
    out[:, 0] = np.bincount(rows, minlength=n)
    solid = ~textkit._SPACE[buf]
    out[:, 1] = _per_row(_POINT[buf] * solid, offs)
    out[:, 2] = _per_row(_SYMBOL[buf], offs)
    # Lines: cut at each line feed and at each text's ends.
    breaks = np.flatnonzero(buf == 10)
    line_ends = np.sort(np.concatenate([breaks, offs[1:]]))
    line_starts = np.sort(np.concatenate([breaks + 1, offs[:-1]]))
    order = np.searchsorted(starts, line_starts)
    worded = (order < len(starts)) & (line_ends > line_starts)
    worded[worded] = starts[order[worded]] < line_ends[worded]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_rows = np.searchsorted(offs, line_starts, "right") - 1
    out[:, 5] = np.bincount(line_rows, minlength=n)
    _, first = textkit.distinct_by_row(textkit.span_hashes(values, line_starts, line_ends), line_rows)
    out[:, 3] = out[:, 5] - np.bincount(first, minlength=n)
    # Words that lie in a window of three found twice or more.
    if len(hashes) >= 3:
        run, _ = hashes[:-2] * np.uint64(textkit._ODD), None
        run = textkit.mix((run + hashes[1:-1]) * np.uint64(textkit._ODD) + hashes[2:])
        inside = rows[:-2] == rows[2:]
        place = np.flatnonzero(inside)
        key = textkit.mix(run[inside] + rows[:-2][inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        covered = np.zeros(len(hashes), dtype=bool)
        at = place[twice]
        for k in range(3):
            covered[at + k] = True
        out[:, 4] = np.bincount(rows[covered], minlength=n)
    out[:, 6] = _per_row(_UPPER[buf], offs)
    out[:, 7] = _per_row(_LETTER[buf], offs)
    _, distinct = textkit.distinct_by_row(hashes, rows)
    out[:, 8] = np.bincount(distinct, minlength=n)
    return out


def _block_entropy(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Entropy, in nats, of the bytes of each text's words."""
    n = len(offs) - 1
    solid = ~textkit._SPACE[buf]
    rows = np.repeat(np.arange(n), np.diff(offs))[solid]
    many = np.bincount(rows * 256 + buf[solid], minlength=n * 256).reshape(n, 256)
    total = np.maximum(many.sum(1), 1)
    return np.log(total) - (many * np.log(np.maximum(many, 1))).sum(1) / total


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        counts, entropy = np.zeros((len(text), len(COUNTS)), dtype=np.int64), np.zeros(len(text))
        for first, end, buf, offs in textkit.blocks(text):
            counts[first:end] = _block_counts(buf, offs)
            entropy[first:end] = _block_entropy(buf, offs)
        kept = [batch.column(k) for k in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(entropy)], names=["doc_id", "lang", "source", *COUNTS, "entropy"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the COUNTS and the byte entropy of every whole text."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", entropy double"
    cast = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))]
    return docs.select(*cast).mapInArrow(_measure, schema)


def with_base(stats: DataFrame) -> DataFrame:
    """Adds ``base_failed``: too few words, or too many of them in repeated windows."""
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def transformed() -> dict[str, Column]:
    """The statistic vector: logs of sizes and square roots of shares, which evens out their spread."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "x_length": F.log1p(words),
        "x_word": F.log(chars / words),
        "x_line": F.log1p(words) - F.log1p(F.col("n_lines").cast("double")),
        "x_upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))),
        "x_other": F.sqrt(1 - F.col("n_letters") / chars),
        "x_variety": F.log1p(F.col("n_distinct_words").cast("double")) / F.log1p(words),
        "x_entropy": F.col("entropy"),
    }


def chi_square_below(x: float, k: int) -> float:
    """Distribution function, by its series."""
    a, half = k / 2.0, x / 2.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-15:
        n += 1.0
        term *= half / n
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile by bisection."""
    low, high = 1e-9, 2000.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, k) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, k: int, dof: float) -> float:
    """Quantile of the squared distance of a k-variate t distribution from its center: k times Fisher's F(k, dof)."""
    share = np.linspace(0.0, 1.0, 400_001)  # of the distance in distance + dof: Beta(k / 2, dof / 2)
    density = share ** (k / 2 - 1) * (1 - share) ** (dof / 2 - 1)
    below = np.concatenate([[0.0], np.cumsum(density[1:] + density[:-1])])
    x = float(np.interp(p, below / below[-1], share))
    return dof * x / (1 - x)


PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
_ESTIMATE = "cell long, start int, n_core long, center array<double>, inverse array<double>, log_det double, ridge double, sums array<double>, products array<double>"
#: Bins per unit of a distance's natural logarithm.
_BINS = 200


def regularised(scatter: np.ndarray, variance: np.ndarray, condition: float) -> tuple[np.ndarray, float]:
    """The scatter mixed with the corpus's variances, just as far as its condition number asks for; and the mixing share."""
    unit = np.sqrt(np.outer(variance, variance))
    least, *_, most = np.linalg.eigvalsh(scatter / unit)
    flat = (1 / condition - least) / (1 - least) if least < 1 / condition else 0.0
    wide = most - condition * least
    ridge = max(flat, wide / (wide + condition - 1) if wide > 0 else 0.0)
    return ((1 - ridge) * scatter / unit + ridge * np.eye(len(variance))) * unit, ridge


def estimate_of(n: float, sums: np.ndarray, products: np.ndarray, scale: float, variance: np.ndarray, condition: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Center, inverse scatter, log determinant and ridge from the moments of a core."""
    p = len(STATS)
    center = sums / n
    scatter = np.zeros((p, p))
    for (i, j), value in zip(PAIRS, products, strict=True):
        scatter[i, j] = scatter[j, i] = (value / n - center[i] * center[j]) * scale
    scatter, ridge = regularised(scatter, variance, condition)
    return center, np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1]), ridge


def _estimate_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (cell, start, n, (center, inverse, log_det, ridge), sums, products) as a batch of _ESTIMATE."""
    low = [[float(m[1][i, j]) for i, j in PAIRS] for _, _, _, m, _, _ in rows]
    floats, lists = pa.float64(), pa.list_(pa.float64())
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
        pa.array([r[3][0].tolist() for r in rows], lists), pa.array(low, lists), pa.array([r[3][2] for r in rows], floats), pa.array([r[3][3] for r in rows], floats),
        pa.array([r[4] for r in rows], lists), pa.array([r[5] for r in rows], lists),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ESTIMATE.split(", ")])


def _estimator(scale: float, variance: np.ndarray, condition: float):
    """Moments of cores to estimates, one row each."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["cell"], r["start"], r["n_core"], estimate_of(r["n_core"], np.array(r["sums"]), np.array(r["products"]), scale, variance, condition), r["sums"], r["products"]) for r in batch.to_pylist()]
            yield _estimate_rows(rows)

    return estimate


def start_inverses(scale: np.ndarray, n: float, signs: np.ndarray, squashed: np.ndarray, products: np.ndarray) -> list[np.ndarray]:
    """Inverse scatters of the three starts, from moments of coordinates divided by their scale."""
    p = len(STATS)
    shape, tied = np.eye(p), np.eye(p)
    for k, (i, j) in enumerate(PAIRS):
        shape[i, j] = shape[j, i] = signs[k] * p / n
        tied[i, j] = tied[j, i] = products[k] / n - squashed[i] * squashed[j] / n**2
    spread = np.sqrt(np.maximum(tied.diagonal(), 1e-12))
    tied = tied / np.outer(spread, spread)
    return [np.linalg.inv((m + 1e-3 * np.eye(p)) * np.outer(scale, scale)) for m in (np.eye(p), shape, tied)]


def _starter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            center = np.array(r["middle"])
            for k, inverse in enumerate(start_inverses(np.array(r["scale"]), r["n"], np.array(r["signs"]), np.array(r["squashed"]), np.array(r["products"]))):
                rows.append((r["cell"], k, r["n"], (center, inverse, 0.0, 0.0), [], []))
        yield _estimate_rows(rows)


def _sums(columns: list[Column], name: str) -> Column:
    return F.array(*(F.sum(c) for c in columns)).alias(name)


def _moments(core: DataFrame) -> DataFrame:
    """Count, sums and products of each core, combined before they are shuffled."""
    x = [F.col(c) for c in STATS]
    return core.groupBy("cell", "start").agg(F.count(F.lit(1)).alias("n_core"), _sums(x, "sums"), _sums([x[i] * x[j] for i, j in PAIRS], "products"))


def _distance() -> Column:
    """Squared Mahalanobis distance as one flat expression."""
    diff = [F.col(c) - F.col("center")[i] for i, c in enumerate(STATS)]
    return reduce(lambda a, b: a + b, (diff[i] * diff[j] * F.col("inverse")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(PAIRS)))


def _bin(distance: Column) -> Column:
    return F.floor(F.log(F.greatest(distance, F.lit(1e-12))) * _BINS).cast("int")


def _cells(usable: DataFrame, min_group: int) -> DataFrame:
    """lang, source, cell and ``small`` of every group: its own cell, its language's rest or the corpus's rest."""
    sizes = usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.col("n") >= min_group)
    language = Window.partitionBy("lang")
    in_rest = F.when(~F.col("own"), F.col("n"))
    sizes = sizes.withColumn("of_lang", F.sum(in_rest).over(language)).withColumn("level", F.when(F.col("own"), 0).when(F.col("of_lang") >= min_group, 1).otherwise(2))
    rest = sizes.where("level = 2").agg((F.coalesce(F.sum("n"), F.lit(0)) < min_group).alias("few"))
    known = lambda c, deepest: [F.when(F.col("level") <= deepest, F.col(c).isNull()), F.when(F.col("level") <= deepest, F.coalesce(c, F.lit("")))]
    flags = [F.coalesce(c.cast("string"), F.lit("-")) for c in (*known("lang", 1), *known("source", 0))]
    placed = sizes.join(F.broadcast(rest), F.lit(True))  # one row
    return placed.select("lang", "source", F.xxhash64("level", *flags).alias("cell"), ((F.col("level") == 2) & F.col("few")).alias("small"))


def estimates(points: DataFrame, support: float, starts_for: int, steps: int, condition: float) -> tuple[DataFrame, np.ndarray]:
    """Estimate of every cell of ``points`` (cell, STATS), and the corpus's variances."""
    p = len(STATS)
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    seen = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.percentile_approx(c, quartiles, 2000) for c in STATS)).alias("q"), _sums([F.col(c) for c in STATS], "s1"), _sums([F.col(c) * F.col(c) for c in STATS], "s2"))
    seen = stored(seen, "quality-seen")
    whole = seen.agg(F.sum("n").alias("n"), *(F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in ("s1", "s2") for i in range(p))).first()
    n = whole["n"] or 1
    variance = np.array([max((whole[f"s2{i}"] or 0.0) / n - ((whole[f"s1{i}"] or 0.0) / n) ** 2, 0.0) for i in range(p)])
    variance[variance < 1e-12] = 1.0  # a statistic without any spread
    near = [(F.col("q")[i][2] - F.col("q")[i][0]) / 1.349 for i in range(p)]
    own = [F.sqrt(F.greatest(F.col("s2")[i] / F.col("n") - F.pow(F.col("s1")[i] / F.col("n"), 2), F.lit(0.0))) for i in range(p)]
    scale = [F.when(a > 1e-9, a).when(b > 1e-9, b).otherwise(float(np.sqrt(v))) for a, b, v in zip(near, own, variance, strict=True)]
    middle = seen.select("cell", "n", F.array(*(F.col("q")[i][1] for i in range(p))).alias("middle"), F.array(*scale).alias("scale"))
    turned = points.join(middle, "cell").select("cell", "n", "middle", "scale", *(((F.col(c) - F.col("middle")[i]) / F.col("scale")[i]).alias(f"z{i}") for i, c in enumerate(STATS)))
    z = [F.col(f"z{i}") for i in range(p)]
    square = F.greatest(reduce(lambda a, b: a + b, (v * v for v in z)), F.lit(1e-12))
    squashed = [F.tanh(v) for v in z]
    turned = turned.groupBy("cell", "n").agg(_sums([z[i] * z[j] / square for i, j in PAIRS], "signs"), _sums(squashed, "squashed"), _sums([squashed[i] * squashed[j] for i, j in PAIRS], "products"))
    estimate = stored(turned.join(middle.drop("n"), "cell").mapInArrow(_starter, _ESTIMATE), "quality-start")
    quantile = chi_square_quantile(support, p)
    # Restores the scale of the covariance of the closest share, for a normal core.
    step = _estimator(support / chi_square_below(quantile, p + 2), variance, condition)
    for k in range(steps):
        near = points.join(estimate.select("cell", "start", "center", "inverse"), "cell").withColumn("bin", _bin(_distance()))
        ordered = Window.partitionBy("cell", "start").orderBy("bin")
        bins = near.groupBy("cell", "start", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("reach", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy("cell", "start")))
        limits = bins.where(F.col("reach") >= F.ceil(F.col("all") * support)).groupBy("cell", "start").agg(F.min("bin").alias("last"))
        # Written out, so that Spark knows how few limits there are and the points aren't dealt by their cells.
        core = near.join(stored(limits, "quality-limits"), ["cell", "start"]).where("bin <= last")
        found = _moments(core).mapInArrow(step, _ESTIMATE)
        if k == starts_for - 1:
            best = Window.partitionBy("cell").orderBy("log_det", "start")
            found = found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
        fresh = stored(found, "quality-step") if k < starts_for else found
        if k >= starts_for:
            old = estimate.select("cell", *(F.col(c).alias(f"was_{c}") for c in estimate.columns if c != "cell"))
            falls = F.col("was_log_det") - F.col("log_det") >= 1e-6
            fresh = stored(fresh.join(old, "cell").select("cell", falls.alias("fell"), *(F.when(falls, F.col(c)).otherwise(F.col(f"was_{c}")).alias(c) for c in estimate.columns if c != "cell")), "quality-step")
            if not fresh.agg(F.bool_or("fell")).first()[0]:
                break
            fresh = fresh.drop("fell")
        estimate = fresh
    wide = chi_square_quantile(0.975, p)
    last = _estimator(0.975 / chi_square_below(wide, p + 2), variance, condition)
    core = points.join(estimate.select("cell", "start", "center", "inverse"), "cell").where(_distance() <= wide)
    ended = _moments(core).mapInArrow(last, _ESTIMATE)
    # A cell none of whose documents is that near keeps what the steps have given.
    ended = estimate.alias("e").join(ended.alias("f"), "cell", "left").select("cell", *(F.when(F.col("f.n_core").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in estimate.columns if c != "cell"))
    return stored(ended, "quality-estimates"), variance


def _pooled(estimate: DataFrame, variance: np.ndarray, condition: float) -> DataFrame:
    """One row: the estimate from the moments of all cores."""
    p, p2 = len(STATS), len(PAIRS)
    total = estimate.agg(F.sum("n_core").alias("n_core"), _sums([F.col("sums")[i] for i in range(p)], "sums"), _sums([F.col("products")[k] for k in range(p2)], "products")).where("n_core > 0")
    scale = 0.975 / chi_square_below(chi_square_quantile(0.975, p), p + 2)
    rows = total.select(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("start"), "n_core", "sums", "products").mapInArrow(_estimator(scale, variance, condition), _ESTIMATE)
    return rows.select(F.col("center").alias("p_center"), F.col("inverse").alias("p_inverse"))


def judge(docs: DataFrame, support: float = 0.75, min_group: int = 100, confidence: float = 0.999, dof: float = 6.0, condition: float = 1000.0, starts_for: int = 2, steps: int = 12) -> DataFrame:
    """doc_id, lang, source, COUNTS, ``base_failed``, ``distance`` and ``kept`` of every document.

    ``kept`` is false for documents that fail the base rule and for outliers of
    their cell. Documents that fail the base rule take no part in the estimates.
    """
    bounded_batches(docs.sparkSession)
    stats = stored(with_base(statistics(docs)).withColumns(transformed()), "quality-statistics")
    usable = stats.where(~F.col("base_failed"))
    cells = stored(_cells(usable, min_group), "quality-cells")
    points = stored(_joined(usable.select("lang", "source", *STATS), cells, ["lang", "source"]).select("cell", *STATS), "quality-points")
    estimate, variance = estimates(points, support, starts_for, steps, condition)
    pooled = stored(_pooled(estimate, variance, condition), "quality-pooled")
    chosen = cells.join(estimate.select("cell", "center", "inverse"), "cell", "left").join(F.broadcast(pooled), F.lit(True), "left")  # one row
    own = ~F.col("small")
    chosen = chosen.select("lang", "source", F.when(own, F.col("center")).otherwise(F.col("p_center")).alias("center"), F.when(own, F.col("inverse")).otherwise(F.col("p_inverse")).alias("inverse"))
    judged = _joined(stats, chosen, ["lang", "source"], how="left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= t_quantile(confidence, len(STATS), dof))
    return judged.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; Spark broadcasts the small side only when it is measured to be small."""
    other = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys))
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))
