"""Hard-negative mining by dual-tree search over anchors and candidates.

Components become whole numbers (floor of ``scale`` times the value), so scores are
whole inner products. A binary tree of principal directions and medians, fitted to a
bounded sample, gives every row a leaf; the rows of a leaf are packed into blocks
of a few thousand, each one row of a table with a matrix. Anchors are packed in
the same way by a shorter prefix of the leaf. Every node of either tree has a centre
and a radius, so the inner products between two nodes lie within
    c1 * c2 +- (|c1| r2 + |c2| r1 + r1 r2).

A search wants, for each anchor, the best k rows with a score inside each of
its bands. Each anchor block first meets one block of its own region, which gives a
floor to each band. Then pairs of nodes go down both trees from the top, 16
children a step: a pair is dropped, with all anchors and candidates below it,
if its interval misses every band of the node (or its labels can't fit). The
pairs of blocks that are left are scored exactly by matrix products, and each
worker raises the floors as it goes. Positives are one such search (rows of the
anchor's label, one open band), negatives a second one (rows of other labels, a band
for each positive).

Where vectors have no structure (independent directions in many dimensions) no
interval excludes anything, and every pair of blocks is scored.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite
component take no part; shorter vectors count as filled up with zeros, an empty
one is all zeros; of rows that repeat the vec_id of an anchor the one with the least
label, then vector, is the anchor, and none of them is its positive or negative;
other repeated rows count each; an anchor without positives or without a row in
the band has no rows; an empty table gives an empty result; extra columns are
ignored. Inner products have to fit a long.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import bounded_batches, stored

_LOWEST = -(1 << 63)
_STRIDE = 4
_MAX_DEPTH = 12
_MAX_LABELS = 32
_BLOCK = "code long, blk long, ids array<long>, labels array<long>, matrix binary, kind string, dim int, centre array<double>, norm double, radius double, longest double, label_set array<long>"
_ANCHOR = f"{_BLOCK}, home long, slots int, lo array<long>, hi array<long>, need_lo long, need_hi long"
_FOUND = "anchor_id long, slot int, vec_id long, score long"


# The tree


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Normals and cuts of the inner nodes of a tree, in heap order: principal direction and median of each node's part."""
    normals, cuts = np.zeros((2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
    parts = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        part = parts.pop(node)
        if len(part):
            around = sample[part] - sample[part].mean(0)
            axis = around[np.argmax((around**2).sum(1))] + 1e-9
            for _ in range(8):
                axis = around.T @ (around @ axis)
                axis = axis / (np.linalg.norm(axis) or 1)
            normals[node], cuts[node] = axis, np.median(sample[part] @ axis)
        right = sample[part] @ normals[node] > cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    return normals, cuts


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), dim), dtype=np.int64)
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _assigner(normals: np.ndarray, cuts: np.ndarray, depth: int, dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim).astype(np.float64)
            node = np.zeros(len(v), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + ((v * normals[node]).sum(1) > cuts[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - (2**depth - 1))], names=[*batch.schema.names, "leaf"])

    return assign


def _ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(0)
    return centre, float(np.sqrt(((points - centre) ** 2).sum(1).max()))


def _packer(dim: int, anchors: bool):
    """One row for each block: its rows in order of id as a matrix, with centre, radius and labels; bands too, if they are anchors."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("vec_id")
        ids, labels = group.column("vec_id"), group.column("label").to_numpy()
        v = _matrix(group.column("v").combine_chunks(), dim)
        most = int(np.abs(v).max(initial=0))
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        centre, radius = _ball(v.astype(np.float64))
        known = np.unique(labels)
        row = {
            "code": group.column("code")[0].as_py(), "blk": group.column("blk")[0].as_py(), "ids": ids.to_pylist(), "labels": labels.tolist(), "matrix": v.astype(kind).tobytes(), "kind": kind, "dim": dim,
            "centre": centre.tolist(), "norm": float(np.linalg.norm(centre)), "radius": radius, "longest": float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max())), "label_set": known.tolist() if len(known) <= _MAX_LABELS else None,
        }
        if anchors:
            bands = group.column("bands").to_pylist()
            slots = max(len(b) for b in bands)
            lo, hi = np.ones((len(bands), slots), np.int64), np.zeros((len(bands), slots), np.int64)  # 1 to 0: no band
            for k, b in enumerate(bands):
                for j, one in enumerate(b):
                    lo[k, j], hi[k, j] = one["lo"], one["hi"]
            leaves, many = np.unique(group.column("leaf").to_numpy(), return_counts=True)
            real = lo <= hi
            row |= {"home": int(leaves[many.argmax()]), "slots": slots, "lo": lo.ravel().tolist(), "hi": hi.ravel().tolist(), "need_lo": int(lo[real].min()) if real.any() else 1, "need_hi": int(hi[real].max()) if real.any() else 0}
        return pa.Table.from_pylist([row], schema=_arrow(_ANCHOR if anchors else _BLOCK))

    return pack


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    of = lambda t: pa.list_(kinds[t[6:-1]]) if t.startswith("array") else kinds[t]
    return pa.schema([(n, of(t)) for n, t in (x.split() for x in ddl.split(", "))])


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``blk``: the rows of each code dealt by a hash of the id into blocks of about ``size``."""
    n = stored(rows.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_n")), "hardneg-sizes")
    return rows.join(n, "code").withColumn("blk", F.pmod(F.xxhash64("vec_id", F.lit(11)), "_n")).drop("_n")


def _levels(blocks: DataFrame, depth: int, anchors: bool) -> list[DataFrame]:
    """Nodes from the top: (node, parent, ball, labels, bands), the last level being the blocks themselves.

    Each level is made of the one below it, so that no task sees more than a leaf's blocks or 16 children.
    """
    bands = ["need_lo", "need_hi"] if anchors else []
    cols = ["n", "centre", "norm", "radius", "label_set", *bands]
    ddl = ", ".join(["parent long", "n long", "centre array<double>", "norm double", "radius double", "label_set array<long>", *(f"{b} long" for b in bands)])

    def join(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        points, radii = np.array(group.column("centre").to_pylist()), group.column("radius").to_numpy()
        centre = (points * n[:, None]).sum(0) / n.sum()
        sets = group.column("label_set").to_pylist()
        known = None if any(s is None for s in sets) else sorted({x for s in sets for x in s})
        row = {"parent": group.column("parent")[0].as_py(), "n": int(n.sum()), "centre": centre.tolist(), "norm": float(np.linalg.norm(centre)), "radius": float((np.sqrt(((points - centre) ** 2).sum(1)) + radii).max())}
        row |= {"label_set": known if known is not None and len(known) <= _MAX_LABELS else None}
        if anchors:  # nodes without a band (1 to 0) don't count
            real = [(a, b) for a, b in zip(group.column("need_lo").to_pylist(), group.column("need_hi").to_pylist(), strict=True) if a <= b] or [(1, 0)]
            row |= {"need_lo": min(a for a, _ in real), "need_hi": max(b for _, b in real)}
        return pa.Table.from_pylist([row], schema=_arrow(ddl))

    below = blocks.select(F.struct("code", "blk").alias("node"), F.col("code").alias("parent"), F.size("ids").cast("long").alias("n"), *cols[1:])
    out = [below]
    # the leaves, then every fourth level above them, up to one of 16 nodes or fewer
    above, low = depth, depth
    while True:
        nodes = stored(below.groupBy("parent").applyInArrow(join, ddl), "hardneg-nodes").withColumnRenamed("parent", "node")
        above = max(low - _STRIDE, 0)
        below = nodes.select("node", F.shiftright("node", low - above).alias("parent"), *cols)
        out.insert(0, below)
        if low <= _STRIDE:
            return out
        low = above


# The search


def _fits(same: bool) -> Column:
    """Whether the intervals and labels of an anchor node and a candidate node (c_) leave anything to find."""
    dot = F.aggregate(F.zip_with("centre", "c_centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    reach = F.col("norm") * F.col("c_radius") + F.col("c_norm") * F.col("radius") + F.col("radius") * F.col("c_radius")
    slack = 1e-9 * (F.col("norm") + F.col("radius")) * (F.col("c_norm") + F.col("c_radius")) + 1e-6  # of rounding
    if same:
        labels = F.coalesce(F.arrays_overlap("label_set", "c_label_set"), F.lit(True))
    else:
        labels = F.coalesce((F.size("label_set") > 1) | (F.size("c_label_set") > 1) | (F.col("label_set")[0] != F.col("c_label_set")[0]), F.lit(True))
    return (F.col("need_lo") <= F.col("need_hi")) & (dot + reach + slack >= F.col("need_lo")) & (dot - reach - slack <= F.col("need_hi")) & labels


def _descend(anchors: list[DataFrame], candidates: list[DataFrame], same: bool) -> DataFrame:
    """Pairs of blocks (a, c) that no pair of nodes above them excludes."""
    named = [level.select(*(F.col(c).alias(f"c_{c}") for c in level.columns)) for level in candidates]
    top = anchors[0].withColumn("c_node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2**_STRIDE - 1).cast("long"))))
    pairs = top.join(named[0], "c_node").where(_fits(same)).select(F.col("node").alias("a"), F.col("c_node").alias("c"))
    for step in range(1, max(len(anchors), len(candidates))):
        pairs = stored(pairs, "hardneg-pairs")
        more_a, more_c = step < len(anchors), step < len(candidates)
        left, right = anchors[min(step, len(anchors) - 1)], named[min(step, len(named) - 1)]
        met = pairs.join(left, pairs["a"] == left["parent" if more_a else "node"]).join(right, pairs["c"] == right["c_parent" if more_c else "c_node"])
        pairs = met.where(_fits(same)).select(F.col("node").alias("a"), F.col("c_node").alias("c"))
    return pairs


def exact_products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Whole inner products; ``bound``, the product of the greatest lengths, limits every partial sum, so floats that hold it are exact."""
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_in_band(scores: np.ndarray, usable: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place of the first k usable scores of each row within [lo, hi]: greatest first, then by column."""
    inside = usable & (scores >= lo[:, None]) & (scores <= hi[:, None])
    if np.count_nonzero(inside) > 8 * k * len(scores) and scores.shape[1] > k:
        held = np.where(inside, scores, _LOWEST)
        inside &= scores >= np.partition(held, -k, axis=1)[:, -k][:, None]
    r, c = np.nonzero(inside)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k], place[place < k]


def _scorer(k: int, same: bool, held_blocks: int = 64):
    """The best k of each anchor and band in every pair of blocks that can still be among its best."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()  # best k scores so far, of the anchor blocks seen last
        for batch in batches:
            found = [[], [], [], []]
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[f"{p}matrix"], row[f"{p}kind"]).reshape(-1, row["dim"]) for p in ("", "c_"))
                ids, c_ids, labels, c_labels = (np.array(row[c], np.int64) for c in ("ids", "c_ids", "labels", "c_labels"))
                lo, hi = (np.array(row[c], np.int64).reshape(len(ids), -1) for c in ("lo", "hi"))
                scores = exact_products(a, b, row["longest"] * row["c_longest"])
                usable = ((labels[:, None] == c_labels) == same) & (ids[:, None] != c_ids)
                key = (row["code"], row["blk"])
                best = floors.pop(key) if key in floors else np.full((*lo.shape, k), _LOWEST)
                for slot in range(lo.shape[1]):
                    r, c, place = best_in_band(scores, usable, np.maximum(lo[:, slot], best[:, slot].min(1)), hi[:, slot], k)
                    new = np.full((len(ids), k), _LOWEST)
                    new[r, place] = scores[r, c]
                    best[:, slot] = np.partition(np.concatenate([best[:, slot], new], axis=1), k, axis=1)[:, k:]
                    for part, values in zip(found, (ids[r], np.full(len(r), slot), c_ids[c], scores[r, c]), strict=True):
                        part.append(values)
                floors[key] = best
                if len(floors) > held_blocks:
                    floors.popitem(last=False)
            whole = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(whole[0]), pa.array(whole[1].astype(np.int32)), pa.array(whole[2]), pa.array(whole[3])], names=["anchor_id", "slot", "vec_id", "score"])

    return score


def _scored(pairs: DataFrame, anchors: DataFrame, leaves: DataFrame, k: int, same: bool) -> DataFrame:
    named = leaves.select(*(F.col(c).alias(f"c_{c}") for c in ("code", "blk", "ids", "labels", "matrix", "kind", "longest")))
    at = lambda side, code, blk: (F.col(f"{side}.code") == F.col(code)) & (F.col(f"{side}.blk") == F.col(blk))
    work = pairs.join(anchors.select("code", "blk", "ids", "labels", "matrix", "kind", "dim", "longest", "lo", "hi"), at("a", "code", "blk")).join(named, at("c", "c_code", "c_blk")).drop("a", "c")
    return work.mapInArrow(_scorer(k, same), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search(anchors: DataFrame, leaves: DataFrame, levels: list[DataFrame], dim: int, depth: int, size: int, k: int, same: bool) -> DataFrame:
    """anchor_id, slot, vec_id, score, rank: the best k rows in each band of each anchor.

    ``anchors``: vec_id, label, v, leaf, code, blk and ``bands``, an array of (lo, hi); a slot is a place in it.
    """
    packed = stored(anchors.groupBy("code", "blk").applyInArrow(_packer(dim, True), _ANCHOR), "hardneg-anchors")
    seeds = packed.select(F.struct("code", "blk").alias("a"), F.struct(F.col("home").alias("code"), F.lit(0).cast("long").alias("blk")).alias("c"))
    seeded = stored(_first(_scored(seeds, packed, leaves, k, same), k), "hardneg-seeds")
    floors = seeded.groupBy("anchor_id", "slot").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    floors = stored(floors.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors")), "hardneg-floors")
    raised = anchors.join(floors, anchors["vec_id"] == floors["anchor_id"], "left")
    higher = F.transform("bands", lambda b, i: F.struct(F.greatest(b["lo"], F.try_element_at("floors", i)).alias("lo"), b["hi"].alias("hi")))
    raised = raised.select(*(anchors[c] for c in anchors.columns if c != "bands"), higher.alias("bands"))
    packed = stored(raised.groupBy("code", "blk").applyInArrow(_packer(dim, True), _ANCHOR), "hardneg-anchors")
    pairs = stored(_descend(_levels(packed, depth, True), levels, same).join(seeds, ["a", "c"], "left_anti"), "hardneg-pairs")
    rest = _scored(pairs, packed, leaves, k, same)
    return stored(_first(seeded.drop("rank").unionByName(rest), k), "hardneg-found")


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label and v (whole numbers) of the rows that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(fine)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def mine(rows: DataFrame, anchor: Column, vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf_rows: int = 4096, anchor_rows: int = 512) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows with ``anchor``, a condition on vec_id. A positive is one of the
    first ``positives`` other rows of the anchor's label; its negatives are
    the first ``negatives`` rows of other labels whose score is between ``low`` and ``high``
    percent of the positive's. Higher scores come first, then smaller ids.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    base = stored(whole_vectors(rows, vector, scale), "hardneg-vectors")
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = max(dim or 1, 1)
    leaf_rows = max(min(leaf_rows, (1 << 19) // dim), 16)  # a block's matrix stays at a few megabytes in any dimension
    anchor_rows = max(min(anchor_rows, (1 << 17) // dim), 16)
    levels_for = lambda many, size: min(max(math.ceil(math.log2(max(many, 1) / size)), 0), _MAX_DEPTH)
    depth = levels_for(n, leaf_rows)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(64 << depth, (1 << 22) // dim)).select("v").toArrow() if depth else None
    normals, cuts = fit_tree(_matrix(sample.column("v").combine_chunks(), dim).astype(np.float64), depth) if depth else (np.zeros((0, dim)), np.zeros(0))
    dealt = stored(base.mapInArrow(_assigner(normals, cuts, depth, dim), "vec_id long, label long, v array<long>, leaf long"), "hardneg-leaves")
    leaves = stored(_blocked(dealt.withColumnRenamed("leaf", "code"), leaf_rows).groupBy("code", "blk").applyInArrow(_packer(dim, False), _BLOCK), "hardneg-blocks")
    levels = _levels(leaves, depth, False)

    chosen = dealt.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v", "leaf")).alias("r")).select("vec_id", "r.*")
    short = levels_for(chosen.count(), anchor_rows)
    anchors = stored(_blocked(chosen.withColumn("code", F.shiftright("leaf", depth - short)), anchor_rows), "hardneg-chosen")
    open_band = F.array(F.struct(F.lit(_LOWEST).alias("lo"), F.lit((1 << 63) - 1).alias("hi")))
    near = _search(anchors.withColumn("bands", open_band), leaves, levels, dim, short, anchor_rows, positives, True)
    near = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # low * P <= 100 * S <= high * P, in whole numbers; a negative P leaves no S
    p = F.col("positive_score")
    band = F.struct("slot", F.when(p < 0, 1).otherwise(F.expr(f"({low} * positive_score + 99) div 100")).cast("long").alias("lo"), F.when(p < 0, 0).otherwise(F.expr(f"({high} * positive_score) div 100")).cast("long").alias("hi"))
    bands = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(band)).alias("_b"))  # ``positives`` bands at most, slots from 0
    bands = bands.select("anchor_id", F.transform("_b", lambda b: F.struct(b["lo"], b["hi"])).alias("bands"))
    banded = stored(anchors.join(bands, anchors["vec_id"] == bands["anchor_id"]).drop("anchor_id"), "hardneg-banded")
    far = _search(banded, leaves, levels, dim, short, anchor_rows, negatives, False)
    found = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(near, ["anchor_id", "slot"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql(scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """DuckDB SQL of the query over ``embeddings``: every row whose id is divisible by 100 against all rows."""
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {negatives}
"""
