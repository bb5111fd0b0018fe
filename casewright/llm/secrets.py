"""Secret scans: two character Markov models, compared by log-likelihood ratio.

One second-order model is fitted to labelled samples of random strings, one to
labelled samples of ordinary identifiers, words, numbers and paths. A candidate
is a maximal run of at least ``MIN_LENGTH`` characters that keys are made of, or
what rule spans leave of one if that is as long; it is a secret when the random model's likelihood
exceeds the ordinary model's by ``threshold`` nats a character. Three rule
families (assignments, access keys, hexadecimal runs) are kept as they are; the
models add spans outside them.

Samples are rows (sample, is_secret), at most ``MAX_SAMPLES`` of them; by
default they come from a seeded generator.

Defined results: null text counts as empty and has no spans; repeated rows are
scanned one by one; an empty table gives an empty result; extra columns are
ignored. Positions are code points, ends exclusive, over whole texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import bounded_batches

#: Bound on the labelled samples that a model is fitted to.
MAX_SAMPLES = 200_000

#: Rule patterns of the three families, letters of the key names in either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "model")
ORDINARY = (
    "account address archive array average backup balance batch browser buffer bucket button cache calendar callback campaign category "
    "channel client cluster column comment compute config connection container content context controller convert counter currency customer "
    "database decode default delete deploy device dictionary directory document download driver element employee encode endpoint engine "
    "entity environment error event exception execute export factory feature filter folder format function gateway generate global group "
    "handler header history identifier image import index information input instance integer interface invoice iterator journal kernel "
    "keyboard language layout library license listener loader location logger machine manager mapping matrix memory message method metric "
    "middleware migration module monitor network notification number object operation option order organization output package parameter "
    "parser partition password pattern payment performance permission platform plugin pointer policy position prefix process product profile "
    "project property protocol provider proxy query queue record reference register relation release report repository request resource "
    "response result router runtime sample schedule schema scope section security selector sequence serialize server service session setting "
    "shared signal snapshot socket source statement static storage stream string structure subscription suffix support switch symbol system "
    "table target template terminal test thread timestamp token toolbar transaction transform translation trigger type update upload user "
    "utility validation value variable vector version virtual visitor widget window worker wrapper international understanding "
    "Verantwortung Entwicklung Geschwindigkeit Wissenschaft Gesellschaft développement gouvernement responsabilidad administración"
).split()

MIN_LENGTH = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
_CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(_CLASSES) + 1  # the last is a start
_CODE = np.full(128, 0, dtype=np.int64)
for _i, _c in enumerate(_CLASSES):
    _CODE[ord(_c)] = _i


def default_samples(seed: int = 7, each: int = 6000) -> list[tuple[str, bool]]:
    """Labelled samples: random strings over the usual key alphabets; identifiers, compounds, paths, numbers and rules put together from words."""
    rng = random.Random(seed)
    lower, upper, digits = _CLASSES[:26], _CLASSES[26:52], _CLASSES[52:62]
    alphabets = [digits + "abcdef", digits + "ABCDEF", _CLASSES[:62], _CLASSES[:62] + "+/", _CLASSES[:62] + "_-", upper + digits, lower + digits, lower, upper, lower + upper]
    words = [w.encode("ascii", "ignore").decode() for w in ORDINARY]
    number = lambda: rng.choice((str(rng.randint(0, 2030)), f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 10**rng.randint(4, 19))}", "0" * rng.randint(2, 12)))
    rule = lambda: rng.choice(rng.choice(("=-_/+", _CLASSES))) * rng.randint(2, 40)
    out: list[tuple[str, bool]] = []
    for k in range(each):
        out.append(("".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(MIN_LENGTH, 64))), True))
        parts = [rng.choice(words) for _ in range(rng.randint(2, 5))]
        style = k % 8
        text = {0: "_".join(parts), 1: "-".join(parts), 2: parts[0] + "".join(p.title() for p in parts[1:]), 3: "/".join(parts), 4: "".join(parts), 5: "_".join(parts).upper(), 6: "".join(p.title() for p in parts), 7: rng.choice((rule() + parts[0] + rule(), "-".join(number() for _ in range(3)), "/".join([*parts, number()]), number() + number()))}[style]
        out.append((text + (number() if style < 7 and rng.random() < 0.3 else ""), False))
    return out


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "ignore"), dtype=np.uint8)
    return _CODE[raw & 127]


def fit(samples: Iterable[tuple[str, bool]], weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> np.ndarray:
    """Log-likelihood ratio of every character after every pair: the random model's minus the ordinary one's.

    Each model mixes the frequencies after pairs, after single characters and
    overall with fixed ``weights``, and every model a little of an even share,
    so that a pair which no sample holds is no proof of either.
    """
    counts = np.zeros((2, _N * _N, _N))
    for k, (text, is_secret) in enumerate(samples):
        if k >= MAX_SAMPLES:
            raise ValueError(f"more than {MAX_SAMPLES} labelled samples")
        code = np.concatenate([[_N - 1, _N - 1], _codes(text or "")])
        np.add.at(counts[int(is_secret)], (code[:-2] * _N + code[1:-1], code[2:]), 1.0)
    share = lambda x, below: (x + below) / (x + below).sum(-1, keepdims=True)
    overall = share(counts.sum(1, keepdims=True), 1.0)
    single = share(counts.reshape(2, _N, _N, _N).sum(1), overall)
    pair = share(counts, np.tile(single, (1, _N, 1)))
    logs = np.log(weights[0] * pair + weights[1] * np.tile(single, (1, _N, 1)) + weights[2] * overall)
    return logs[1] - logs[0]


def ratio(model: np.ndarray, text: str) -> float:
    """Mean log-likelihood ratio of a string's characters, in nats."""
    code = np.concatenate([[_N - 1, _N - 1], _codes(text)])
    return float(model[code[:-2] * _N + code[1:-1], code[2:]].mean()) if len(text) else 0.0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the rule families, leftmost and non-overlapping within a kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]


_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
#: Texts that match none of these (the patterns themselves, without what only bounds a match) have neither a rule span nor a candidate.
_SCREEN = "|".join((ASSIGN, ACCESS, HEX.removeprefix("(?<![0-9a-f])"), _CANDIDATE.pattern))


def pieces(start: int, end: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans leave of [start, end), as far as it is ``MIN_LENGTH`` or longer."""
    out, at = [], start
    for s, e, _ in sorted(taken):
        if s < end and e > at:
            out.append((at, s))
            at = e
    return [(a, b) for a, b in (*out, (at, end)) if b - a >= MIN_LENGTH]


def model_spans(text: str, model: np.ndarray, threshold: float, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the candidates outside rule spans that the likelihood ratio finds random."""
    found = [piece for m in _CANDIDATE.finditer(text) for piece in pieces(m.start(), m.end(), taken)]
    return [(a, b, 3) for a, b in found if ratio(model, text[a:b]) > threshold]


def _scanner(model: np.ndarray, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            hot = np.asarray(pc.fill_null(pc.match_substring_regex(text, _SCREEN), False))
            lists: list[list[dict]] = [[] for _ in range(len(text))]
            for k in np.flatnonzero(hot).tolist():
                whole = text[k].as_py()
                spans = rule_spans(whole)
                spans += model_spans(whole, model, threshold, spans)
                lists[k] = [{"kind": KINDS[kind], "start": s, "end": e} for s, e, kind in sorted(spans, key=lambda x: (x[0], x[2]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return scan


def scan(docs: DataFrame, samples: Iterable[tuple[str, bool]] | None = None, threshold: float = 0.3) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end; ordered by start, then kind) of every document."""
    bounded_batches(docs.sparkSession)
    model = fit(default_samples() if samples is None else samples)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scanner(model, threshold), "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The lowercase hex of a list of spans, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
