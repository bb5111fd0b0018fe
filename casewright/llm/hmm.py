"""Language-model scoring by a hidden Markov model over word classes.

The ``own`` most frequent words are classes of their own; every other word
belongs to one of ``buckets`` classes by its last two bytes, within which it has
a smoothed unigram probability; the end of a text is the last class. A model of
``states`` latent states emits the classes. Baum-Welch runs over all training
texts: each task adds up expected counts of its texts, the counts are summed
across partitions, and the sums give the next parameters. The likelihood of a
text is exact: scaled forward recursion over the whole sequence, vectorised over
texts, times the words' probabilities within their classes.

Word counts cover the whole training corpus. Only the most frequent words travel
to the driver and the executors: all whose count reaches the least level at
which no more than ``frequent`` words do, found from a histogram of counts.
Counts of all the others meet the texts that use them in one shuffled join of
distinct (text, word) pairs.

Words are 64-bit hashes of their bytes with A-Z folded. Defined results: null or
empty text is its end alone; without training texts every count is 0; repeated
rows are scored one by one; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches, stored

from . import textkit

_TOKENS = 1 << 20


def _words(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and bucket of every word of a block."""
    starts, ends, rows = textkit.word_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), rows, np.zeros(0, np.int64)
    hashes = textkit.span_hashes(textkit._LOWER_VALUES[buf], starts, ends)
    folded = textkit._LOWER[buf]
    tail = folded[ends - 1].astype(np.uint64) | (np.where(ends - starts > 1, folded[ends - 2], 0).astype(np.uint64) << np.uint64(8))
    return hashes, rows, (textkit.mix(tail + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _counter(buckets: int):
    """Partial word counts of a partition; flushed when many words are held."""

    def flush(held: list) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in held])
        values, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        many = np.bincount(code, weights=np.concatenate([n for _, _, n in held])).astype(np.int64)
        return values, np.concatenate([b for _, b, _ in held])[first], many

    def emit(held: list) -> pa.RecordBatch:
        values, bucket, many = flush(held)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(many)], names=["word", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, buf, offs in textkit.blocks(batch.column("text")):
                hashes, _, bucket = _words(buf, offs, buckets)
                held.append((hashes, bucket, np.ones(len(hashes), np.int64)))
                size += len(hashes)
                if size > 3 * _TOKENS:
                    held = [flush(held)]
                    size = len(held[0][0])
                    if size > 2 * _TOKENS:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)

    return count


@dataclass
class Lexicon:
    words: np.ndarray  # the frequent words, sorted
    logs: np.ndarray  # log10(count + 0.5) of each
    cls: np.ndarray  # class of each that is a class of its own, else -1
    bucket_logs: np.ndarray  # log10 of each bucket's denominator
    own: int
    buckets: int
    mass: np.ndarray  # training tokens of each class
    total: int
    distinct: int
    ends: int

    @property
    def n_classes(self) -> int:
        return self.own + self.buckets + 1


def _level(n: Column) -> Column:
    """Counts by levels: each of its own up to 1024, then 64 to every doubling."""
    return F.when(n <= 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).cast("long")


def _lexicon(counts: DataFrame, ends: int, own: int, buckets: int, frequent: int) -> Lexicon:
    per = {r.bucket: (r.n, r.v) for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    levels = sorted(((r.level, r.many) for r in counts.groupBy(_level(F.col("n")).alias("level")).agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True)
    reach = np.cumsum([many for _, many in levels])
    least = min((level for (level, _), total in zip(levels, reach, strict=True) if total <= frequent), default=None)
    top = counts.where(_level(F.col("n")) >= least if least is not None else F.lit(False)).select("word", "bucket", "n").toArrow()
    words = np.asarray(top.column("word")).astype(np.int64).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    n = np.asarray(top.column("n")).astype(np.int64)
    bucket = np.asarray(top.column("bucket")).astype(np.int64)
    rank = np.lexsort((words.view(np.int64), -n))
    cls = np.full(len(words), -1, dtype=np.int64)
    cls[rank[:own]] = np.arange(min(own, len(words)))
    mass, kinds = np.zeros(buckets), np.zeros(buckets)
    for k, (a, b) in per.items():
        mass[k], kinds[k] = a, b
    mine = cls >= 0
    mass -= np.bincount(bucket[mine], weights=n[mine], minlength=buckets)
    kinds -= np.bincount(bucket[mine], minlength=buckets)
    order = np.argsort(words)
    weights = np.zeros(own + buckets + 1)
    weights[cls[mine]] = n[mine]
    weights[own : own + buckets] = mass
    weights[-1] = ends
    total, distinct = sum(a for a, _ in per.values()) + ends, sum(b for _, b in per.values()) + (ends > 0)
    return Lexicon(words[order], np.log10(n + 0.5)[order], cls[order], np.log10(mass + 0.5 * (kinds + 1)), own, buckets, weights, int(total), int(distinct), ends)


_ENCODED = "row long, doc_id long, held_out boolean, n_words long, known long, base double, own_base double, bucket_base double, classes binary, rare array<long>, rare_n array<int>"


def _encoder(lex: Lexicon):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offs in textkit.blocks(batch.column("text")):
                n = end - first
                hashes, rows, bucket = _words(buf, offs, lex.buckets)
                cls = lex.own + bucket
                known = np.zeros(len(hashes), dtype=bool)
                logs = np.zeros(len(hashes))
                if len(lex.words):
                    at = np.minimum(np.searchsorted(lex.words, hashes), len(lex.words) - 1)
                    known = lex.words[at] == hashes
                    logs = np.where(known, lex.logs[at], 0.0)
                    mine = known & (lex.cls[at] >= 0)
                    cls = np.where(mine, lex.cls[at], cls)
                else:
                    mine = known
                add = lambda values: np.bincount(rows, weights=values, minlength=n).astype(float)  # noqa: E731  without rows it counts in integers
                rare, rare_rows = hashes[~known], rows[~known]
                order = np.lexsort((rare, rare_rows))
                rare, rare_rows = rare[order], rare_rows[order]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_rows[1:] != rare_rows[:-1])
                start = np.flatnonzero(new)
                many = np.diff(np.concatenate([start, [len(rare)]])).astype(np.int32)
                rare, rare_rows = rare[start], rare_rows[start]
                rare_offs = textkit.row_bounds(rare_rows, n).astype(np.int32)
                sizes = np.bincount(rows, minlength=n)
                # each text's classes, then its end
                stops = np.cumsum(sizes + 1)
                flat = np.full(int(stops[-1]) if n else 0, lex.n_classes - 1, dtype=np.uint16)
                flat[np.arange(len(cls)) + rows] = cls
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], stops * 2]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(sizes.astype(np.int64)), pa.array(add(known).astype(np.int64)), pa.array(add(logs)), pa.array(add(np.where(mine, logs, 0.0))),
                        pa.array(add(np.where(mine, 0.0, lex.bucket_logs[bucket]))), data, pa.ListArray.from_arrays(pa.array(rare_offs), pa.array(rare.view(np.int64))), pa.ListArray.from_arrays(pa.array(rare_offs), pa.array(many)),
                    ],
                    names=[f.split()[0] for f in _ENCODED.split(", ")],
                )

    return encode


class Packed:
    """Sequences of classes laid out by time step, longest first, for recursions over all of them at once."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        lens = sizes[self.order]
        flat = np.concatenate([sequences[k] for k in self.order])
        steps = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.active = np.searchsorted(-lens, -np.arange(int(lens[0])), "left")  # how many are longer than t
        self.offs = np.concatenate([[0], np.cumsum(self.active)])
        self.rank = np.repeat(np.arange(len(lens)), lens)
        slot = self.offs[steps] + self.rank
        self.cls = np.empty(len(flat), dtype=np.int64)
        self.cls[slot] = flat
        by = np.empty(len(flat), dtype=np.int64)
        by[slot] = self.rank
        self.rank = by

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward recursion: emission rows, scaled alphas (all if ``keep``) and the scale of each step."""
        out = np.ascontiguousarray(emit.T)[self.cls]
        alphas = out if keep else out[:0]
        if keep:
            alphas = np.empty_like(out)
        scale = np.empty(len(out), dtype=out.dtype)
        now = None
        for t in range(len(self.active)):
            low, n = self.offs[t], self.active[t]
            now = start * out[low : low + n] if now is None else (now[:n] @ move) * out[low : low + n]
            total = now.sum(1)
            now /= total[:, None]
            scale[low : low + n] = total
            if keep:
                alphas[low : low + n] = now
        return out, alphas, scale

    def log10(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """log10 likelihood of every sequence, in the order given."""
        _, _, scale = self.forward(start, move, emit)
        found = np.bincount(self.rank, weights=np.log10(scale), minlength=len(self.order))
        out = np.empty(len(self.order))
        out[self.order] = found
        return out

    def expected(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch's expected counts of starts, moves and emissions, and the log10 likelihood."""
        k = len(start)
        out, alphas, scale = self.forward(start, move, emit, keep=True)
        moves = np.zeros((k, k))
        later = np.ones((0, k), dtype=out.dtype)
        for t in range(len(self.active) - 1, -1, -1):
            low, n = self.offs[t], self.active[t]
            now = alphas[low : low + n]
            beta = np.ones((n, k), dtype=out.dtype)
            m = len(later)
            if m:
                moves += now[:m].T @ later
                beta[:m] = later @ move.T
            later = out[low : low + n] * beta / scale[low : low + n, None]
            now *= beta
        emits = np.stack([np.bincount(self.cls, weights=alphas[:, j], minlength=emit.shape[1]) for j in range(k)])
        return alphas[: self.active[0]].sum(0).astype(float), moves * move, emits, float(np.log10(scale, dtype=float).sum())


def _packs(batches: Iterator[pa.RecordBatch], limit: int = _TOKENS) -> Iterator[tuple[Packed, list[pa.RecordBatch]]]:
    """Sequences in packs of about ``limit`` tokens, with the batches that they fill."""
    held: list[np.ndarray] = []
    parts: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        column = batch.column("classes")
        first = 0
        for k in range(len(column)):
            held.append(np.frombuffer(column[k].as_buffer(), dtype=np.uint16))
            size += len(held[-1])
            if size >= limit:
                parts.append(batch.slice(first, k + 1 - first))
                yield Packed(held), parts
                held, parts, size, first = [], [], 0, k + 1
        if first < len(column):
            parts.append(batch.slice(first))
    if held:
        yield Packed(held), parts


def _expecter(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        small = [x.astype(np.float32) for x in (start, move, emit)]
        for pack, _ in _packs(batches):
            *parts, likelihood = pack.expected(*small)
            counts = np.concatenate([*(x.reshape(-1) for x in parts), [likelihood]])
            total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    return expect


def _scorer(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, parts in _packs(batches):
            whole = pa.Table.from_batches(parts).drop_columns(["classes"]).combine_chunks()
            whole = whole.append_column("sequence", pa.array(pack.log10(start, move, emit)))
            yield from whole.to_batches()

    return score


def _normal(x: np.ndarray, prior: float) -> np.ndarray:
    x = x + prior
    return x / x.sum(-1, keepdims=True)


def train(encoded: DataFrame, mass: np.ndarray, states: int, rounds: int, seed: int, least_gain: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission probabilities by Baum-Welch over all rows that are not held out.

    It ends when a round raises the log likelihood by less than ``least_gain``
    of itself, or after ``rounds``.
    """
    rng = np.random.default_rng(seed)
    n_classes = len(mass)
    # States begin as seeded distortions of the classes' shares and tend to stay, so that texts can pull them apart.
    start, move = np.full(states, 1.0 / states), _normal(np.eye(states) * states, 0.5)
    emit = _normal((mass + 0.5) * np.exp(rng.normal(0, 1, (states, n_classes))), 0.0)
    texts = encoded.where("not held_out").select("classes")
    before = None
    for _ in range(rounds):
        cells = texts.mapInArrow(_expecter(start, move, emit), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        if not cells.num_rows:
            break
        flat = np.zeros(states + states * states + states * n_classes + 1)
        flat[np.asarray(cells.column("cell"))] = np.asarray(cells.column("n"))
        start = _normal(flat[:states], 0.1)
        move = _normal(flat[states : states + states * states].reshape(states, states), 0.1)
        emit = _normal(flat[states + states * states : -1].reshape(states, n_classes), 0.1 / n_classes)
        if before is not None and flat[-1] - before < least_gain * abs(before):
            break
        before = flat[-1]
    return start, move, emit


def score(docs: DataFrame, held_out: Column, own: int = 1023, buckets: int = 512, frequent: int = 262_144, states: int = 6, rounds: int = 6, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the rows that are not ``held_out``. Scores are log10
    probabilities; ``base_score`` is that of the smoothed unigram model.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learned = texts.where(~F.col("held_out"))
    counts = stored(learned.select("text").mapInArrow(_counter(buckets), "word long, bucket int, n long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")), "lm-counts")
    lex = _lexicon(counts, learned.count(), own, buckets, frequent)
    encoded = stored(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(_encoder(lex), _ENCODED), "lm-encoded")
    model = train(encoded, lex.mass, states, rounds, seed)
    pairs = encoded.select("row", F.explode(F.arrays_zip(F.col("rare").alias("w"), F.col("rare_n").alias("k"))).alias("p")).select("row", F.col("p.w").alias("word"), F.col("p.k").alias("k"))
    met = pairs.join(counts.select("word", "n"), "word", "left")
    rare = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("rare_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    schema = "row long, doc_id long, held_out boolean, n_words long, known long, base double, own_base double, bucket_base double, sequence double"
    scored = encoded.select("row", "doc_id", "held_out", "n_words", "known", "base", "own_base", "bucket_base", "classes").mapInArrow(_scorer(*model), schema)
    both = scored.join(rare, "row", "left")
    rest = F.coalesce(F.col("rare_base"), F.lit(0.0))
    tokens = F.col("n_words") + 1
    denominator = float(np.log10(lex.total + 0.5 * (lex.distinct + 1)))
    base = F.col("base") + rest + float(np.log10(lex.ends + 0.5)) - tokens * denominator
    inner = F.col("base") - F.col("own_base") + rest - F.col("bucket_base")
    known = F.col("known") + F.coalesce(F.col("rare_known"), F.lit(0)) + int(lex.ends > 0)
    return both.select("doc_id", "held_out", tokens.alias("n_tokens"), known.alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("sequence") + inner).alias("score"))
