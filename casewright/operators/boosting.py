"""Gradient-boosted trees for two or more classes over sparse vectors, with one joint softmax.

Values of a feature are cut into bins at quantiles; a feature that a row doesn't have is a bin of
its own, which each split sends to its better side. A round grows one tree for
each class, all levels of all trees at once: workers add up gradients by
(class, node, feature, bin) over packed blocks of rows, Spark sums them, and a query over these
sums picks the best split of every node. Rows and features are sampled anew in
each round by hashes, so a repeated task sees the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import bounded_batches, stored

_BLOCK = "ids array<long>, labels binary, rows binary, features binary, bins binary, margins binary"
_SUMS = "class int, node int, feature int, bin int, g double, h double"


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from whole numbers."""
    x = (x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Tree:
    """A complete tree in heap order: inner nodes with feature (-1: all go left), cut (bins up to it go left) and the side of absent ones; values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    absent_left: np.ndarray
    value: np.ndarray

    def step(self, node: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """The children that rows at ``node`` go to."""
        f = self.feature[node]
        b = dense[np.arange(len(node)), np.maximum(f, 0)]
        left = np.where(f < 0, True, np.where(b == 0, self.absent_left[node], b <= self.cut[node]))
        return 2 * node + 2 - left


@dataclass
class Model:
    classes: list
    edges: dict[int, np.ndarray]
    n_features: int
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)


class _Block:
    """A packed block of rows: its bins as a dense matrix, 0 where a row doesn't have a feature."""

    def __init__(self, row: dict, n_features: int, n_classes: int):
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], "<i4")
        self.rows, self.features, self.bins = (np.frombuffer(row[c], "<i4") for c in ("rows", "features", "bins"))
        self.margins = np.frombuffer(row["margins"], "<f8").reshape(len(self.ids), n_classes)
        self.dense = np.zeros((len(self.ids), max(n_features, 1)), dtype=np.int16)
        self.dense[self.rows, self.features] = self.bins

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        p = np.exp(self.margins - self.margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p - (np.arange(p.shape[1]) == self.labels[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def _packer(edges: dict[int, np.ndarray], n_classes: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                vectors = part.column("vector").to_pylist()
                rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors]).astype("<i4")
                features = np.array([e["index"] for v in vectors for e in v], dtype="<i4")
                values = np.array([e["value"] for v in vectors for e in v], dtype=np.float64)
                bins = np.zeros(len(features), dtype="<i4")
                for f in np.unique(features):
                    mine = features == f
                    bins[mine] = 1 + np.searchsorted(edges[int(f)], values[mine], "left")
                labels = np.asarray(part.column("label")).astype("<i4")
                margins = np.zeros((len(vectors), n_classes), dtype="<f8")
                yield pa.RecordBatch.from_pylist([{"ids": part.column("id").to_pylist(), "labels": labels.tobytes(), "rows": rows.tobytes(), "features": features.tobytes(), "bins": bins.tobytes(), "margins": margins.tobytes()}], schema=_schema())

    return pack


def _schema() -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("labels", "rows", "features", "bins", "margins"))])


def _adder(trees: list[Tree], level: int, model: Model, n_bins: int, sample: float, seed: int):
    """Sums of gradients by class, node of a level, feature and bin (feature -1: all of the node) over a task's blocks."""
    k, nodes, f = len(model.classes), 2**level, model.n_features

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_all, h_all = np.zeros((k, nodes)), np.zeros((k, nodes))
        g_sum, h_sum = np.zeros((k, nodes * f * n_bins)), np.zeros((k, nodes * f * n_bins))
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, f, k)
                used = _hashed(block.ids, seed) < sample
                g, h = (x * used[:, None] for x in block.gradients())
                for c, tree in enumerate(trees):
                    node = np.zeros(len(block.ids), dtype=np.int64)
                    for _ in range(level):
                        node = tree.step(node, block.dense)
                    at = node - (nodes - 1)
                    slot = (at[block.rows] * f + block.features) * n_bins + block.bins
                    for total, sums, x in ((g_all, g_sum, g[:, c]), (h_all, h_sum, h[:, c])):
                        total[c] += np.bincount(at, x, nodes)
                        sums[c] += np.bincount(slot, x[block.rows], nodes * f * n_bins)
        c, slot = np.nonzero(h_sum)
        ac, an = np.nonzero(h_all)
        parts = [np.concatenate(x) for x in ((ac, c), (an, slot // (f * n_bins) if f else slot), (np.full(len(ac), -1), slot // n_bins % max(f, 1)), (np.zeros(len(ac)), slot % n_bins))]
        yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int32)) for p in parts), pa.array(np.concatenate([g_all[ac, an], g_sum[c, slot]])), pa.array(np.concatenate([h_all[ac, an], h_sum[c, slot]]))], names=["class", "node", "feature", "bin", "g", "h"])

    return add


def _best_splits(sums: DataFrame, ridge: float, least: float, allowed: Column) -> DataFrame:
    """Per class and node: all gradients and the split with the greatest gain, absent rows on either side."""
    summed = stored(sums.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")), "boosting-sums")
    whole = summed.where("feature = -1").select("class", "node", F.col("g").alias("ga"), F.col("h").alias("ha"))
    of = Window.partitionBy("class", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = summed.where((F.col("feature") >= 0) & allowed).select("class", "node", "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(of).alias("gp"), F.sum("h").over(of).alias("hp")).join(whole, ["class", "node"])
    score = lambda g, h: g * g / (h + ridge)
    tried = None
    for left in (True, False):
        gl = F.col("gl") + (F.col("ga") - F.col("gp") if left else F.lit(0.0))
        hl = F.col("hl") + (F.col("ha") - F.col("hp") if left else F.lit(0.0))
        gr, hr = F.col("ga") - gl, F.col("ha") - hl
        gain = score(gl, hl) + score(gr, hr) - score(F.col("ga"), F.col("ha"))
        one = cuts.where((hl >= least) & (hr >= least)).select("class", "node", F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.lit(left).alias("left")).alias("s"))
        tried = one if tried is None else tried.unionByName(one)
    best = tried.groupBy("class", "node").agg(F.max("s").alias("s"))
    return whole.join(best, ["class", "node"], "left").select("class", "node", "ga", "ha", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("cut"), "s.left")


def _advance(trees: list[Tree], model: Model):
    """The blocks with a round's leaf values added to their margins."""
    f, k, depth = model.n_features, len(model.classes), model.depth

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = _Block(row, f, k)
                out.append(row | {"margins": (block.margins + _values(trees, block.dense, depth)).astype("<f8").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return advance


def _values(trees: list[Tree], dense: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros((len(dense), len(trees)))
    for c, tree in enumerate(trees):
        node = np.zeros(len(dense), dtype=np.int64)
        for _ in range(depth):
            node = tree.step(node, dense)
        out[:, c] = tree.value[node - (2**depth - 1)]
    return out


def fit(rows: DataFrame, n_features: int, rounds: int = 20, depth: int = 4, rate: float = 0.3, n_bins: int = 32, row_share: float = 0.8, column_share: float = 0.8, ridge: float = 1.0, least: float = 1.0, seed: int = 42) -> Model:
    """A model of ``label`` (any type, few values) from ``vector`` arrays of (index, value); ``id`` is a whole number."""
    bounded_batches(rows.sparkSession)
    classes = [r[0] for r in rows.select("label").where("label is not null").distinct().orderBy("label").collect()]
    if len(classes) < 2:
        raise ValueError("training needs two classes or more")
    long = rows.where("label is not null").select(F.explode("vector").alias("e")).select("e.index", "e.value")
    shares = [k / n_bins for k in range(1, n_bins)]
    cuts = long.groupBy("index").agg(F.percentile_approx("value", F.array(*map(F.lit, shares)), F.lit(1000)).alias("q")).collect()
    edges = {int(r["index"]): np.unique(np.array(r.q)) for r in cuts}
    coded = F.element_at(F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(k)))), F.col("label"))
    size = max(64, (1 << 20) // max(n_features, 1))
    packed = rows.where("label is not null").select(F.col("id").cast("long").alias("id"), coded.alias("label"), "vector")
    blocks = stored(packed.mapInArrow(_packer(edges, len(classes), size), _BLOCK), "boosting-blocks")
    model = Model(classes, edges, n_features, depth)
    for turn in range(rounds):
        inner = 2**depth - 1
        trees = [Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner, bool), np.zeros(inner + 1)) for _ in classes]
        open_ = {(c, 0) for c in range(len(classes))}
        chosen = np.flatnonzero(_hashed(np.arange(n_features), seed * 1000 + turn) < column_share).tolist() or list(range(n_features))
        allowed = F.col("feature").isin(chosen) if len(chosen) < n_features else F.lit(True)
        for level in range(depth):
            sums = blocks.mapInArrow(_adder(trees, level, model, n_bins + 1, row_share, seed * 7919 + turn), _SUMS)
            for s in _best_splits(sums, ridge, least, allowed).collect():  # one row for each class and node
                c, node = s["class"], s["node"] + 2**level - 1
                if (c, node) not in open_:
                    continue
                tree = trees[c]
                if s["gain"] is not None and s["gain"] > 1e-9:
                    tree.feature[node], tree.cut[node], tree.absent_left[node] = s["feature"], s["cut"], s["left"]
                    open_ |= {(c, 2 * node + 1), (c, 2 * node + 2)}
                open_.discard((c, node))
                # What the node is worth; leaves below take it until their own level tells better.
                _settle(tree, node, -rate * s["ga"] / (s["ha"] + ridge))
        sums = blocks.mapInArrow(_adder(trees, depth, model, n_bins + 1, row_share, seed * 7919 + turn), _SUMS).where("feature = -1")
        for s in sums.groupBy("class", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            trees[s["class"]].value[s["node"]] = -rate * s["g"] / (s["h"] + ridge)
        model.rounds.append(trees)
        blocks = stored(blocks.mapInArrow(_advance(trees, model), _BLOCK), "boosting-blocks")
    return model


def _settle(tree: Tree, node: int, value: float) -> None:
    low = high = node
    while low < len(tree.feature):
        low, high = 2 * low + 1, 2 * high + 2
    tree.value[low - len(tree.feature) : high - len(tree.feature) + 1] = value


def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, ``probabilities`` in the order of the model's classes, and ``prediction``, the likeliest class (the first of equals)."""
    bounded_batches(rows.sparkSession)
    kinds = dict(rows.dtypes)
    k = len(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            dense = np.zeros((len(vectors), max(model.n_features, 1)), dtype=np.int16)
            for i, v in enumerate(vectors):
                for e in v or ():
                    if e["index"] in model.edges:
                        dense[i, e["index"]] = 1 + np.searchsorted(model.edges[e["index"]], e["value"], "left")
            margins = sum((_values(t, dense, model.depth) for t in model.rounds), np.zeros((len(vectors), k)))
            p = np.exp(margins - margins.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(p.argmax(1).astype(np.int32))], names=[*keep, "probabilities", "_at"])

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "probabilities array<double>", "_at int"])
    names = F.array(*(F.lit(c) for c in model.classes))
    return rows.select(*keep, "vector").mapInArrow(run, ddl).select(*keep, "probabilities", F.get(names, F.col("_at")).alias("prediction"))


def check_scores(scored: DataFrame, model: Model) -> DataFrame:
    """Scored rows that break the model's contract, with ``problem``: shape, not_finite, not_a_share or unknown_class. There must be none."""
    p = F.col("probabilities")
    bad = (
        F.when(p.isNull() | (F.size(p) != len(model.classes)), "shape").when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.exists(p, lambda x: (x < 0) | (x > 1)) | (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6), "not_a_share").when(~F.coalesce(F.col("prediction").isin(*model.classes), F.lit(False)), "unknown_class")
    )
    return scored.withColumn("problem", bad).where("problem is not null")


def classified(scored: DataFrame, model: Model, k: int) -> DataFrame:
    """Scored rows with ``top``, the k likeliest classes and their probabilities; equals keep the order of the classes."""
    from .metrics import top_k

    labels = F.array(*(F.lit(c) for c in model.classes))
    pairs = F.arrays_zip(labels.alias("label"), F.col("probabilities").alias("score"))
    pairs = F.transform(pairs, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))
    return scored.withColumn("top", top_k(pairs, k))
