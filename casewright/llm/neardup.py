"""MinHash near-duplicates by tensored banding, with exact verification.

Two small collections of ``half_keys`` hash tuples (``half_width`` minhashes
each) are computed for a text. Its table keys are all pairs of a tuple of the
first and one of the second: 2 * 10 * 3 = 60 minhashes give 100 keys of six
minhashes, which plain banding would need 600 for. Two texts at Jaccard
similarity 0.85 share no key with probability below 2e-4.

Only half keys that two different shingle sets share are combined into pairs,
so a text that resembles no other never makes a key. Texts with equal shingle
sets are one representative from the start. Representatives that share a key
are gathered under the key's smallest one (its pivot); two that share a key
share that pivot. A gathering's members are dealt into blocks of about ``block``
members (fewer if they are long), and exact intersections of whole shingle sets
within a unit of work come from chunked 0/1 matrix products.

A gathering of one block is one unit. In a larger one all members meet the pivot
first; then those not yet known to be in the pivot's component meet one block,
then two more, four more and so on, until each has joined it or has met every
block. A link between two members that both joined early can't change a
component, so nothing is lost, and a template with g near copies costs about g
comparisons with its pivot and few more, not g * g. A unit returns only a
spanning forest of its links.

Defined results: null, empty or blank text has no shingles, is linked with
nothing and kept; a text with fewer words than a shingle is one shingle;
rows that repeat a doc_id are one node of the graph with the links of all of
them, and come back once per row; a null doc_id is linked with nothing, has no
component and is kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches, cut, stored

from . import textkit
from .components import components

_CHUNK = 4096


def _coefficients(n: int, seed: int) -> np.ndarray:
    return textkit.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(textkit._ODD) + np.uint64(seed)) | np.uint64(1)


def _signer(width: int, half_keys: int, half_width: int, seed: int):
    """Set size, fingerprint and half keys of every whole text."""
    n_hashes = 2 * half_keys * half_width
    factors = _coefficients(n_hashes, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, buf, offs in textkit.blocks(batch.column("text")):
                n = len(offs) - 1
                hashes, rows = textkit.words(buf, offs)
                found, at = textkit.distinct_by_row(*textkit.shingles(hashes, rows, n, width))
                sizes = np.bincount(at, minlength=n)
                filled = np.flatnonzero(sizes)
                bounds = np.searchsorted(at, filled)
                prints = np.zeros((n, 2), dtype=np.uint64)
                halves = np.zeros((n, 2 * half_keys), dtype=np.uint64)
                if len(filled):
                    prints[filled, 0] = np.add.reduceat(textkit.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)
                    prints[filled, 1] = np.bitwise_xor.reduceat(textkit.mix(found + np.uint64(textkit._ODD)), bounds)
                    for key in range(2 * half_keys):
                        value = np.full(len(filled), key + 1, dtype=np.uint64)
                        for k in range(key * half_width, (key + 1) * half_width):
                            value = textkit.mix(value + np.minimum.reduceat(found * factors[k], bounds))
                        halves[filled, key] = value
                parts.append((sizes, prints, halves))
            sizes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            prints = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 2), np.uint64)
            halves = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, 2 * half_keys), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * 2 * half_keys), pa.array(halves.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(prints[:, 0].copy().view(np.int64)), pa.array(prints[:, 1].copy().view(np.int64)), lists], names=["doc_id", "n_shingles", "p0", "p1", "halves"])

    return sign


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by ``keys``, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(sets: np.ndarray, at: np.ndarray, n: int, percent: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among n sets (values ordered by row): pairs of one ``left`` and one ``right`` member."""
    sizes = np.bincount(at, minlength=n)
    if n == 2:
        shared = len(np.intersect1d(sets[at == 0], sets[at == 1], assume_unique=True))
        return [(1, 0)] if 100 * shared >= percent * (sizes[0] + sizes[1] - shared) and sizes.min() else []
    values, code, many = np.unique(sets, return_inverse=True, return_counts=True)
    common = many[code] > 1
    code, rows = code[common], at[common]
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    dense = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    shared = np.zeros((len(a), len(b)), dtype=np.float32)
    step = 0
    width = int(dense[-1]) + 1 if len(dense) else 0
    for low in range(0, width, _CHUNK):
        end = int(np.searchsorted(dense, low + _CHUNK))
        matrix = np.zeros((n, min(_CHUNK, width - low)), dtype=np.float32)
        matrix[rows[step:end], dense[step:end] - low] = 1
        shared += matrix[a] @ matrix[b].T
        step = end
    union = sizes[a][:, None] + sizes[b][None, :] - shared
    linked = (100.0 * shared >= percent * union) & (union > 0)
    label = np.arange(n)
    big = n
    while True:
        near_a = np.where(linked, label[b][None, :], big).min(1, initial=big)
        near_b = np.where(linked, label[a][:, None], big).min(0, initial=big)
        nxt = label.copy()
        np.minimum.at(nxt, a, near_a)
        np.minimum.at(nxt, b, near_b)
        nxt = np.minimum(nxt, nxt[nxt])
        if (nxt == label).all():
            break
        label = nxt
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(n))]


def _verifier(width: int, percent: int):
    """Links of each unit (pivot, lo, hi) between its ``left`` and its ``right`` rows, from whole texts."""

    def emit(found: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["pivot", "a", "b", "joined"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bool]] = []
        for group in _grouped(batches, ["pivot", "lo", "hi"]):
            n = group.num_rows
            if n < 2:
                continue
            pivot = group.column("pivot")[0].as_py()
            ids, left, right, joined = (np.asarray(group.column(c)) for c in ("rep", "left", "right", "joined"))
            sets, at = [], []
            base = 0
            for chunk in group.column("text").chunks:
                for first, end, buf, offs in textkit.blocks(chunk):
                    hashes, rows = textkit.words(buf, offs)
                    found, where = textkit.distinct_by_row(*textkit.shingles(hashes, rows, end - first, width))
                    sets.append(found)
                    at.append(where + base + first)
                base += len(chunk)
            links = _forest(np.concatenate(sets), np.concatenate(at), n, percent, left, right)
            roots = {y for x, y in links if joined[x]} | {y for _, y in links if joined[y]}
            held += [(pivot, int(ids[x]), int(ids[y]), y in roots) for x, y in links]
            if len(held) >= 8192:
                yield emit(held)
                held = []
        yield emit(held)

    return verify


def _verified(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pivot, a, b and whether they are known to be in the pivot's component, of every link that ``units`` show."""
    work = units.join(texts, units["rep"] == texts["doc_id"]).select("pivot", "lo", "hi", "rep", "left", "right", "joined", "text")
    dealt = work.repartition(F.col("pivot"), F.col("lo"), F.col("hi")).sortWithinPartitions("pivot", "lo", "hi", "rep", "left")
    return dealt.mapInArrow(_verifier(width, percent), "pivot long, a long, b long, joined boolean")


def _flags(left: Column | bool, right: Column | bool, joined: Column | bool) -> list[Column]:
    return [(c if isinstance(c, Column) else F.lit(c)).alias(n) for c, n in ((left, "left"), (right, "right"), (joined, "joined"))]


def _large_links(large: DataFrame, texts: DataFrame, width: int, percent: int, block: int, block_shingles: int, seed: int) -> DataFrame:
    """Links of gatherings of several blocks (pivot, rep, width_, n_blocks, blk): pivots first, then growing runs of blocks."""
    texts = stored(texts.join(large.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "neardup-texts")
    pivots = large.select("pivot", "blk").distinct()
    met = large.where("rep <> pivot").select("pivot", F.col("blk").alias("lo"), F.lit(0).alias("hi"), "rep", *_flags(True, False, False))
    met = met.unionByName(pivots.select("pivot", F.col("blk").alias("lo"), F.lit(0).alias("hi"), F.col("pivot").alias("rep"), *_flags(False, True, True)))
    edges = stored(_verified(met, texts, width, percent), "neardup-links")
    joined = lambda: edges.where("joined").select("pivot", F.explode(F.array("a", "b")).alias("rep")).unionByName(large.select("pivot", F.col("pivot").alias("rep"))).distinct()
    n_blocks = large.agg(F.max("n_blocks")).first()[0]
    low, high = 0, 1
    while low < n_blocks:
        known = stored(joined(), "neardup-joined")
        open_ = stored(large.join(known, ["pivot", "rep"], "left_anti"), "neardup-open")
        if open_.isEmpty():
            break
        size = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("width_") / F.lit(block_shingles))).cast("int")
        chunks = open_.groupBy("pivot").agg(size.alias("n_chunks"))
        left = open_.join(chunks, "pivot").select("pivot", F.pmod(F.xxhash64("rep", F.lit(seed + 1)), "n_chunks").cast("int").alias("lo"), F.explode(F.sequence(F.lit(low), F.least(F.lit(high), "n_blocks") - 1)).alias("hi"), "rep", *_flags(True, False, False))
        state = large.where(F.col("blk").between(low, high - 1)).join(known.withColumn("known", F.lit(True)), ["pivot", "rep"], "left")
        right = state.join(chunks, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("lo"), F.col("blk").alias("hi"), "rep", *_flags(False, True, F.coalesce("known", F.lit(False))))
        edges = edges.unionByName(stored(_verified(left.unionByName(right), texts, width, percent), "neardup-links"))
        low, high = high, 2 * high + 1
    return edges


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, half_keys: int = 10, half_width: int = 3, block: int = 400, block_shingles: int = 1_000_000, seed: int = 20240229) -> DataFrame:
    """doc_id, n_shingles, component_id and ``kept`` for every document.

    Documents are linked when 100 * shared >= ``percent`` * union of their sets
    of ``width``-word shingles; component_id is the smallest doc_id reachable.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(texts.mapInArrow(_signer(width, half_keys, half_width, seed), "doc_id long, n_shingles long, p0 long, p1 long, halves array<long>"))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    reps = filled.groupBy("n_shingles", "p0", "p1").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n_copies"))
    # Only sets with copies need a join to find their representative; written out, so that a hot set can be split.
    copies = stored(reps.where("n_copies > 1").select("n_shingles", "p0", "p1", F.col("rep").alias("first_copy")), "set-copies")
    halves = reps.select("rep", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    own = halves.join(shared, "half", "left_semi").groupBy("rep").agg(*(F.collect_set(F.when((F.col("place") < half_keys) == (side == 0), F.col("half"))).alias(f"side{side}") for side in (0, 1)))
    keyed = cut(own.select("rep", F.explode(F.flatten(F.transform("side0", lambda x: F.transform("side1", lambda y: F.xxhash64(x, y))))).alias("key")))
    pivots = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot")
    # Members and sizes are written out, so that a hot pivot's members can be split where they meet their size.
    members = stored(keyed.join(pivots, "key").select("pivot", "rep").distinct().join(reps.groupBy("rep").agg(F.max("n_shingles").alias("width_")), "rep"), "neardup-pairs")
    # Long texts make small blocks: a block holds about ``block`` members and ``block_shingles`` shingles at most.
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("width_") / F.lit(block_shingles))).cast("int")
    sizes = stored(members.groupBy("pivot").agg(n_blocks.alias("n_blocks")), "neardup-sizes")
    dealt = stored(members.join(sizes, "pivot").select("pivot", "rep", "width_", "n_blocks", F.pmod(F.xxhash64("rep", F.lit(seed)), "n_blocks").cast("int").alias("blk")), "neardup-members")
    bodies = texts.where("text is not null and doc_id is not null")
    small = dealt.where("n_blocks = 1").select("pivot", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "rep", *_flags(True, True, False))
    edges = _verified(small, bodies.join(small.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), width, percent).select("a", "b")
    large = dealt.where("n_blocks > 1")
    if not large.isEmpty():
        edges = edges.unionByName(_large_links(large, bodies, width, percent, block, block_shingles, seed).select("a", "b"))
    own_rep = signed.select("doc_id", "n_shingles", "p0", "p1").join(copies, ["n_shingles", "p0", "p1"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("first_copy", "doc_id")))
    # The sets of a repeated doc_id are tied together.
    ids = own_rep.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    tied = own_rep.join(stored(ids.where("least <> most"), "neardup-ties"), "doc_id").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    found = components(edges.unionByName(tied)).withColumnsRenamed({"node": "rep"})
    placed = own_rep.join(found, "rep", "left")
    component = F.coalesce(F.col("component"), F.col("rep"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
