"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords: all byte 2-, 3- and
4-grams of the text with A-Z folded and white space as one separator, hashed
into ``buckets``. A linear softmax on that mean gives the language. Embeddings
and output weights are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled texts (``sample`` whole texts, the ones
with the smallest hash of doc_id, as far as they fit into ``sample_bytes``) and on short passages of them, so that short
texts are judged as well. A temperature fitted on a fold that was left out
calibrates the scores, and the calibrated score below which a prediction is
rejected is the one that keeps ``keep`` of that fold's right predictions.

The prediction multiplies embeddings and weights once into one value for each
bucket and language, so a text costs one small table look-up a subword.

Defined results: null text and text without a letter is ``und`` with score 0;
rows without a language teach nothing; without any labelled row every text is
``und``; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches

from . import textkit

UNKNOWN = "und"
GRAMS = (2, 3, 4)
_FOLD = textkit._LOWER.copy()
_FOLD[[*range(0x09, 0x0E)]] = 0x20


@dataclass
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int


def subwords(buf: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every subword of a block, one array pair for each gram size."""
    folded = _FOLD[buf].astype(np.uint32)
    n = len(folded)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs)) if n else np.zeros(0, np.int64)
    code = folded.copy()
    for size in range(2, max(GRAMS) + 1):
        if n < size:
            return
        code = (code[:-1] << np.uint32(8)) | folded[size - 1 :]
        inside = rows[: n - size + 1] == rows[size - 1 :]
        if size in GRAMS:
            bucket = ((code ^ np.uint32(size * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            yield bucket[inside], rows[: n - size + 1][inside]


def _bags(texts: list[str], bits: int) -> np.ndarray:
    """Share of each bucket among a text's subwords."""
    out = np.zeros((len(texts), 1 << bits), dtype=np.float32)
    buf, offs = textkit.text_buffer(pa.array(texts, pa.large_string()))
    for bucket, rows in subwords(buf, offs, bits):
        out += np.bincount(rows * (1 << bits) + bucket, minlength=out.size).reshape(out.shape)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def _passages(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    length = int(rng.integers(2, 30))
    start = int(rng.integers(0, max(1, len(words) - length)))
    return " ".join(words[start : start + length])


def fit(rows: list[tuple[str, str]], bits: int = 14, dim: int = 16, epochs: int = 6, least_steps: int = 240, rate: float = 20.0, batch: int = 64, keep: float = 0.995, seed: int = 11) -> Model | None:
    """Model of (text, language) rows; none without rows."""
    rows = [(t, y) for t, y in rows if t and y is not None]
    if not rows:
        return None
    languages = tuple(sorted({y for _, y in rows}))
    place = {y: k for k, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = max(1, len(rows) // 6) if len(rows) >= 12 else 0
    fold, train = order[:held], order[held:]
    embedding = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weights = np.zeros((dim, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    epochs = max(epochs, -(-least_steps // max(1, -(-len(train) // batch))))
    steps = epochs * max(1, -(-len(train) // batch))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, -(-len(train) // batch))):
            whole = [rows[k] for k in part]
            texts = [t if rng.random() < 0.5 else _passages(t, rng) for t, _ in whole]
            x = _bags(texts, bits)
            y = np.array([place[v] for _, v in whole])
            hidden = x @ embedding
            p = _softmax(hidden @ weights + bias)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            speed = rate * (1 - step / steps)
            back = p @ weights.T
            weights -= speed * (hidden.T @ p)
            bias -= 0.1 * speed * p.sum(0)
            embedding -= speed * (x.T @ back)
            step += 1
    table = (embedding @ weights).astype(np.float32)
    temperature, reject = 1.0, 0.0
    if held:
        texts = [rows[k][0] for k in fold] + [_passages(rows[k][0], rng) for k in fold]
        y = np.array([place[rows[k][1]] for k in fold] * 2)
        logits = np.concatenate([_bags(texts[a : a + batch], bits) @ table for a in range(0, len(texts), batch)]) + bias
        scale = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in scale]
        temperature = float(scale[int(np.argmin(loss))])
        best = _softmax(logits / temperature)
        right = best.max(1)[best.argmax(1) == y]
        reject = float(np.quantile(right, 1 - keep)) if len(right) else 0.0
    return Model(languages, table, bias, temperature, reject, bits)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
            n = len(text)
            names = np.full(n, UNKNOWN, dtype=object)
            scores = np.zeros(n)
            if model is not None:
                k = len(model.languages)
                for first, end, buf, offs in textkit.blocks(text):
                    sums, count = np.zeros((end - first, k)), np.zeros(end - first)
                    for bucket, rows in subwords(buf, offs, model.bits):
                        count += np.bincount(rows, minlength=end - first)
                        for j in range(k):
                            sums[:, j] += np.bincount(rows, weights=model.table[:, j][bucket], minlength=end - first)
                    p = _softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                    names[first:end] = np.array(model.languages, dtype=object)[p.argmax(1)]
                    scores[first:end] = p.max(1)
                names[~lettered] = UNKNOWN
                scores[~lettered] = 0.0
            sure = (scores >= model.reject_below) if model is not None else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(~(sure & lettered))], names=["doc_id", "lang_pred", "score", "rejected"])

    return predict


def training_rows(docs: DataFrame, usable: Column, sample: int, sample_bytes: int) -> list[tuple[str, str]]:
    """At most ``sample`` labelled whole texts of at most ``sample_bytes`` in all, the ones with the smallest hash of doc_id.

    The ids are chosen first, by their texts' sizes, so that only the chosen
    texts come to the driver; a text that doesn't fit any more is passed over.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
    chosen, room = [], sample_bytes
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
        if r.size <= room:
            chosen.append(r.doc_id)
            room -= r.size
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "chosen long").coalesce(1)
    met = rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("chosen")))  # at most ``sample`` ids
    return [(r.text, r.lang) for r in met.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()]


def identify(docs: DataFrame, usable: Column | None = None, sample: int = 2400, sample_bytes: int = 64_000_000, **options) -> DataFrame:
    """doc_id, lang_pred, score and ``rejected`` of every document; learns from the ``usable`` rows with a language."""
    bounded_batches(docs.sparkSession)
    model = fit(training_rows(docs, F.lit(True) if usable is None else usable, sample, sample_bytes), **options)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, rejected boolean")
