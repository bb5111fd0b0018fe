"""Benchmark decontamination by SimHash windows and exact verification.

Every benchmark item has the 64-bit SimHash of its weighted five-word shingles.
A document is read through windows of as many words as an item has; each
window's SimHash comes from differences of running sums. Candidates are found
by multi-index Hamming blocks: with ``radius`` r and eight blocks of 8 bits, two
fingerprints within r differ by at most r // 8 bits in one block, so the table
of all block values within r // 8 of an item's block misses none. A candidate
within the radius is verified by exact weighted Jaccard similarity of window
and item, at least ``similarity``; a shingle's weight falls with the number of
items, of the whole benchmark, that hold it.

A window that shares no shingle with an item has similarity 0 to it, so windows
are only made in texts that hold a shingle of an item (a test without loss), for
the lengths of the items concerned and near the shared shingles, and only the
items concerned are candidates. A text with fewer words than an item is one
window, and its exact similarity is taken without the SimHash test. An item with
fewer words than a shingle is one shingle, so the windows of its length match it
wherever they hold just its words.

The benchmark's shingles are counted by one aggregation. Its items go to the
executors in blocks of at most ``items_per_block`` items and ``block_bytes``
bytes of text, with the counts of their own shingles: one pass over the
documents for each block, of which a benchmark up to that size has one. Workers
build the tables, about 1.2 KB an item.

Defined results: null, empty or blank documents and items match nothing; a text
with fewer than five words is one shingle; repeated rows are judged one by one,
and equal rows of the benchmark count once; a null doc_id is judged like any other; items with a
null id match nothing; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches, stored

from . import textkit

_BITS = 64
_BLOCKS = 8


def _signs(shingles: np.ndarray) -> np.ndarray:
    """-1 or 1 by bit, one row for each shingle."""
    raw = textkit.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (as eight blocks of 8 bits) of rows of weighted sign sums."""
    return np.packbits(sums > 0, axis=1)


def _within(radius: int) -> np.ndarray:
    """All 8-bit masks with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(8), k)], dtype=np.uint8)


class Items:
    """A block of benchmark items as arrays: shingles, weights, fingerprints and the multi-index by length."""

    def __init__(self, rows: tuple[tuple[int, str], ...], counts: dict[int, int], n_items: int, width: int, radius: int):
        """``counts``: how many of the ``n_items`` items hold a shingle, where that is more than one."""
        column = pa.array([t for _, t in rows], pa.large_string())
        buf, offs = textkit.text_buffer(column)
        hashes, at = textkit.words(buf, offs)
        lengths = np.bincount(at, minlength=len(rows))
        runs, owner = textkit.shingles(hashes, at, len(rows), width)
        keep = np.flatnonzero(lengths > 0)
        self.width, self.radius = width, radius
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.lengths = lengths
        self.vocabulary = vocabulary = np.unique(runs)
        self.weights = np.log(1.0 + n_items / np.array([counts.get(v, 1) for v in vocabulary.tolist()], dtype=float)) if len(vocabulary) else np.zeros(0)
        self.unknown = float(np.log(1.0 + max(1, n_items)))
        self.sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        prints = np.zeros((len(rows), _BLOCKS), dtype=np.uint8)
        bounds = textkit.row_bounds(owner, len(rows))
        for k in keep.tolist():
            mine = runs[bounds[k] : bounds[k + 1]]
            prints[k] = _pack((_signs(mine) * self.weight(mine)[:, None]).sum(0, keepdims=True))[0]
            self.sets[k] = np.unique(mine, return_counts=True)
        self.prints = prints
        # shingle -> items that hold it
        found, who = textkit.distinct_by_row(runs, owner)
        order = np.argsort(found, kind="stable")
        self.holder = who[order]
        self.holder_at = np.searchsorted(found[order], np.concatenate([vocabulary, vocabulary[-1:] + np.uint64(1)])) if len(vocabulary) else np.zeros(1, np.int64)
        # items that are shorter than a shingle: length -> their shingles, ascending, and the items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths[keep][lengths[keep] < width]).tolist():
            mine = np.flatnonzero(lengths[owner] == n)
            mine = mine[np.argsort(runs[mine], kind="stable")]
            self.short[n] = runs[mine], owner[mine]
        masks = _within(radius // _BLOCKS)
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.unique(lengths[keep]).tolist():
            members = np.flatnonzero(lengths == n)
            tables = []
            for b in range(_BLOCKS):
                values = (prints[members, b][:, None] ^ masks[None, :]).reshape(-1)
                owners = np.repeat(members.astype(np.int32), len(masks))
                by = np.argsort(values, kind="stable")
                tables.append((np.searchsorted(values[by], np.arange(257)).astype(np.int32), owners[by]))
            self.index[n] = tables

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.vocabulary, shingles), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == shingles, self.weights[at], self.unknown)

    def candidates(self, n: int, prints: np.ndarray, concerned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, by the multi-index; only of items that ``concerned`` is true for."""
        found = []
        for b, (starts, owners) in enumerate(self.index[n]):
            kept = concerned[owners]
            starts = np.concatenate([[0], np.cumsum(kept)])[starts]
            owners = owners[kept]
            low, high = starts[prints[:, b]], starts[prints[:, b].astype(np.int64) + 1]
            many = high - low
            at = np.repeat(np.arange(len(prints)), many)
            found.append(at * len(concerned) + owners[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(concerned))
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= self.radius
        return window[near], item[near]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two multisets of shingles."""
        mine, have = np.unique(window, return_counts=True)
        theirs, want = self.sets[item]
        values = np.union1d(mine, theirs)
        a, b = np.zeros(len(values)), np.zeros(len(values))
        a[np.searchsorted(values, mine)] = have
        b[np.searchsorted(values, theirs)] = want
        w = self.weight(values)
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())


@functools.lru_cache(maxsize=2)
def _built(rows: tuple[tuple[int, str], ...], counts: tuple[tuple[int, int], ...], n_items: int, width: int, radius: int) -> Items:
    return Items(rows, dict(counts), n_items, width, radius)


def match_text(hashes: np.ndarray, items: Items, similarity: float) -> list[tuple[int, int, int, float]]:
    """(item row, first word, next word, similarity): each item's best window in one text."""
    width = items.width
    n_words = len(hashes)
    one_row = np.zeros(n_words, np.int64)
    runs, _ = textkit.shingles(hashes, one_row, 1, width)
    if not len(runs) or not len(items.vocabulary):
        return []
    best: dict[int, tuple[float, int, int]] = {}
    for n, (values, owners) in items.short.items():
        own, _ = textkit.shingles(hashes, one_row, 1, n, whole_if_short=False)
        found, first = np.unique(own, return_index=True)
        for value, start in zip(found[np.isin(found, values)], first[np.isin(found, values)].tolist(), strict=True):
            for item in owners[np.searchsorted(values, value) : np.searchsorted(values, value, "right")].tolist():
                best[item] = (1.0, start, start + n)
    at = np.minimum(np.searchsorted(items.vocabulary, runs), len(items.vocabulary) - 1)
    shared = np.flatnonzero(items.vocabulary[at] == runs)
    weights = items.weight(runs)
    concerned = np.unique(np.concatenate([np.zeros(0, np.int64), *(items.holder[items.holder_at[v] : items.holder_at[v + 1]] for v in np.unique(at[shared]).tolist())]))
    concerned = concerned[items.lengths[concerned] >= width]
    wanted = np.zeros(len(items.lengths), dtype=bool)
    wanted[concerned] = True
    for item in concerned[items.lengths[concerned] > n_words].tolist():
        score = items.similarity(runs, item)
        if score >= similarity:
            best[item] = (score, 0, n_words)
    for n in np.unique(items.lengths[concerned][items.lengths[concerned] <= n_words]).tolist():
        span = n - width + 1  # shingles of a window
        near = np.zeros(len(runs) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(0, shared - span + 1), 1)
        np.add.at(near, shared + 1, -1)
        firsts = np.flatnonzero(np.cumsum(near)[: len(runs) - span + 1] > 0)
        for part in range(0, len(firsts), 4096):
            some = firsts[part : part + 4096]
            low, high = int(some[0]), int(some[-1]) + span
            sums = np.zeros((high - low + 1, _BITS))
            np.cumsum(_signs(runs[low:high]) * weights[low:high, None], axis=0, out=sums[1:])
            prints = _pack(sums[some + span - low] - sums[some - low])
            for w, item in zip(*(x.tolist() for x in items.candidates(n, prints, wanted)), strict=True):
                first = int(some[w])
                score = items.similarity(runs[first : first + span], item)
                if score >= similarity and score > best.get(item, (0.0, 0, 0))[0]:
                    best[item] = (score, first, first + n)
    return [(k, s, e, score) for k, (score, s, e) in sorted(best.items())]


def _matcher(held: tuple[tuple[int, str], ...], counts: tuple[tuple[int, int], ...], n_items: int, width: int, radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(held, counts, n_items, width, radius)
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(items.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            out: list[tuple[int, int, int, int, float]] = []
            ids = batch.column("doc_id")
            for first, end, buf, offs in textkit.blocks(batch.column("text")):
                n = end - first
                hashes, rows = textkit.words(buf, offs)
                runs, at = textkit.shingles(hashes, rows, n, items.width)
                for length in items.short:
                    more, where = textkit.shingles(hashes, rows, n, length, whole_if_short=False)
                    runs, at = np.concatenate([runs, more]), np.concatenate([at, where])
                maybe = np.flatnonzero(bitmap[(runs >> np.uint64(44)).astype(np.int64)])
                if not len(maybe):
                    continue
                place = np.minimum(np.searchsorted(items.vocabulary, runs[maybe]), len(items.vocabulary) - 1)
                hit = np.unique(at[maybe[items.vocabulary[place] == runs[maybe]]])
                bounds = textkit.row_bounds(rows, n)
                for row in hit.tolist():
                    doc = ids[first + row].as_py()
                    out += [(doc, int(items.ids[k]), s, e, score) for k, s, e, score in match_text(hashes[bounds[row] : bounds[row + 1]], items, similarity)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "start_word", "end_word", "similarity"])

    return run


def _shingles_of(rows: DataFrame, width: int) -> DataFrame:
    """The distinct shingles of every item."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in textkit.blocks(batch.column("text")):
                hashes, at = textkit.words(buf, offs)
                found, _ = textkit.distinct_by_row(*textkit.shingles(hashes, at, len(offs) - 1, width))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    return rows.select("text").mapInArrow(shingles, "shingle long")


def _blocks(rows: DataFrame, most: int, most_bytes: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in bounded blocks, one partition of them at the driver at a time."""
    held, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text)
        if len(held) == most or size >= most_bytes:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 23, items_per_block: int = 65_536, block_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, item_id, start_word, end_word and similarity of every item that a document holds; the best window of each."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    n_items, shared = rows.count(), stored(_shingles_of(rows, width).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "benchmark-shingles")
    schema = "doc_id long, item_id long, start_word long, end_word long, similarity double"
    parts = []
    for block in _blocks(rows, items_per_block, block_bytes):
        own = spark.createDataFrame(list(block), "item_id long, text string")
        found = shared.join(_shingles_of(own, width), "shingle", "left_semi").toArrow().to_pydict()
        counts = tuple((s & 0xFFFFFFFFFFFFFFFF, n) for s, n in zip(found["shingle"], found["n"], strict=True))
        parts.append(texts.mapInArrow(_matcher(block, counts, n_items, width, radius, similarity), schema))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns.

    Rows are told apart by a 64-bit hash of doc_id and text, so one with a null
    doc_id goes if its text holds an item, and a clean one stays though its
    doc_id is that of a row with an item. Null and blank texts stay; equal rows
    share their fate; an empty table or benchmark changes nothing.
    """
    row = F.xxhash64(docs["doc_id"], docs["text"])
    leaks = find_leaks(docs.select(row.alias("doc_id"), docs["text"]), benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    leaks = stored(leaks, "decontam-leaks")  # written out, so that its size is known
    return docs.join(leaks, row == leaks["_leaked"], "left_anti")
