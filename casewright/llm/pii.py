"""Personal data by candidate gradient boosting, in DataFrame expressions.

High-recall generators, one for each further kind, propose spans that may
overlap each other and the rule spans; a candidate's format (digits, length,
separators, check sums) and context (words before it, characters around it) are
its features; boosted regression trees score it; a threshold per kind, the
least score that reaches ``precision`` on a calibration half of the labelled
candidates, selects redactions, and of those that overlap the one with the
highest score. Four rule kinds (email, ip, card, phone) are kept whatever their
score; a proposal that lies within one of their spans adds nothing and is left out.

Positions of all matches of a pattern come from the pieces between the matches
(``split``) and the matches (``regexp_extract_all``) by running sums of their
lengths, in two levels so that a text with n matches costs about n ** 1.5 steps.
Repeated groups are possessive and starts are anchored, so that no text, however
long, makes the matcher recurse or rescan.

The trees are fitted on the driver to a bounded seeded table of labelled texts,
whose features are made by the same expressions. A fitted forest is one literal
array of complete trees that an ``aggregate`` walks, so a plan doesn't grow with
the number of trees. The spans are written to a narrow table in the shared
folder once.

Defined results: null text counts as empty and has no spans; repeated rows are
scanned one by one; an empty table gives an empty result; extra columns are
ignored. Positions are code points, ends exclusive, over whole texts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import stored

MAX_LABELLED = 20_000
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_words", "phone_local", "national_id", "iban")

#: Patterns of the rule kinds, anchored and possessive where nothing that follows can need a retry.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of the other kinds.
MORE_PATTERNS = {
    "email_words": r"(?<![A-Za-z0-9._-])[A-Za-z][A-Za-z0-9._-]{1,40}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z]{2,12}){1,3}",
    "phone_local": r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Words of the context that speak for or against personal data.
FOR_WORDS = r"(?i)\b(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|mobile|cell|fax|dial|sms|whatsapp|ssn|social|security|passport|identity|iban|account|bank|transfer|payee)\b"
AGAINST_WORDS = r"(?i)\b(?:version|release|build|section|chapter|order|invoice|isbn|issn|page|pages|figure|table|ref|reference|sku|part|model|item|lot|score|range|years|from|date|ticket|case|serial)\b"

FEATURES = ("kind", "length", "digits", "separators", "parens", "letters", "uppers", "for_words", "against_words", "before_letter", "before_symbol", "after_letter", "runs", "distinct_digits")


def running(lengths: Column) -> Column:
    """Sums of all earlier elements, for every element of an array of numbers."""
    n = F.size(lengths)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    n_parts = F.ceil(n / width).cast("int")
    sums = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: total(F.slice(lengths, i * width + 1, width)))
    heads = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: total(F.slice(sums, F.lit(1), i)))
    place = lambda k: F.floor(k / width).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(heads, place(k)) + total(F.slice(lengths, place(k) * width + 1, k - place(k) * width)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<int>"))


def with_matches(df: DataFrame, name: str, pattern: str, screen: Column) -> DataFrame:
    """Adds ``name``: (start, end, found) of every match of ``pattern`` in ``text``, where ``screen`` holds."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(screen, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(empty))
    df = df.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(empty))
    df = df.withColumn("_before", F.transform("_found", lambda x, k: F.length(F.get("_pieces", k))))
    df = df.withColumn("_sums", running(F.transform("_found", lambda x, k: F.length(x) + F.get("_before", k))))
    spans = F.transform("_found", lambda x, k: F.struct((F.get("_sums", k) + F.get("_before", k)).cast("long").alias("start"), (F.get("_sums", k) + F.get("_before", k) + F.length(x)).cast("long").alias("end"), x.alias("found")))
    return df.withColumn(name, spans).drop("_found", "_pieces", "_before", "_sums")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a string of digits whose check sum holds."""

    def step(total: Column, k: Column) -> Column:
        v = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, v).otherwise(F.when(v > 4, v * 2 - 9).otherwise(v * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str):
    """The rule that a match of a rule kind must pass."""
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return lambda s: F.forall(F.split(s["found"], r"\."), lambda p: F.when(small(p), F.substring(p, -3, 3).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = lambda s: F.length(_digits(s["found"]))
        return lambda s: F.when((n(s) >= 13) & (n(s) <= 19), luhn(_digits(s["found"]))).otherwise(False)
    if kind == "phone":
        return lambda s: F.length(_digits(s["found"])).between(9, 15)
    return lambda s: F.lit(True)


def _candidate(s: Column) -> Column:
    """A proposed span (kind, start, end, found) with its features in the order of FEATURES."""
    found, start, end = s["found"], s["start"].cast("int"), s["end"].cast("int")
    before = F.substring("text", F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40)))
    last, after = F.substring(before, -1, 1), F.substring("text", end + 1, F.lit(1))
    count = lambda p: F.regexp_count(found, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    digits = _digits(found)
    values = {
        "kind": s["kind"].cast("double"),
        "length": F.length(found).cast("double"),
        "digits": F.length(digits).cast("double"),
        "separators": count(r"[ ./-]"),
        "parens": count(r"[()\[\]{}]"),
        "letters": count("[a-z]"),
        "uppers": count("[A-Z]"),
        "for_words": flag(before.rlike(FOR_WORDS)),
        "against_words": flag(before.rlike(AGAINST_WORDS)),
        "before_letter": flag(F.rtrim(last).rlike(r"[A-Za-z]")),
        "before_symbol": flag(last.rlike(r"[$€£#%=*]")),
        "after_letter": flag(after.rlike(r"[A-Za-z0-9%]")),
        "runs": count("[0-9]+"),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
    }
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*(values[k] for k in FEATURES)).alias("x"))


def proposals(texts: DataFrame) -> DataFrame:
    """Adds ``base`` (kind, start, end) and ``more`` (kind, start, end and features ``x``) to rows with a ``text``."""
    text = F.col("text")
    digit, at = text.rlike("[0-9]"), text.contains("@")
    word_at = text.rlike(r"\x20at\x20[A-Za-z0-9-]+(?:\x20dot\x20|\x20?[(\[]dot|\.[A-Za-z])|[(\[{]at[)\]}]")
    many = lambda pattern: F.when(digit, text.rlike(pattern)).otherwise(False)
    screens = {
        "email": at, "ip": many(r"[0-9]\.[0-9]"), "card": digit, "phone": text.contains("+"),
        "email_words": word_at, "phone_local": many(r"[0-9][)\x20./-][\x20]?[0-9]{3}"), "national_id": many(r"[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}"), "iban": many(r"[A-Z]{2}[0-9]{2}"),
    }
    df = texts
    for kind, pattern in {**PATTERNS, **MORE_PATTERNS}.items():
        df = with_matches(df, f"_{kind}", pattern, screens[kind])
    tagged = lambda kind: F.transform(F.filter(f"_{kind}", _valid(kind)), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = df.withColumn("base", F.concat(*(tagged(k) for k in BASE_KINDS)))
    proposed = [F.transform(f"_{kind}", _marked(k)) for k, kind in enumerate(MORE_KINDS)]
    outside = F.filter(F.concat(*proposed), lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    df = df.withColumn("_more", outside).withColumn("more", F.transform("_more", _candidate))
    return df.drop("_more", *(f"_{k}" for k in (*BASE_KINDS, *MORE_KINDS)))


def _marked(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))


def default_labels(seed: int = 23, n: int = 1600) -> list[tuple[str, bool]]:
    """Labelled texts with one candidate each: personal data in its usual settings, and look-alikes in theirs."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice("anna ben carla david eva frank gina hugo ida jan kim lea max nora otto paul".split())
    filler = lambda: " ".join(rng.choice("the of on reader text other long short page note and for with it over".split()) for _ in range(rng.randint(0, 6)))
    good = rng.choice
    out = []
    for k in range(n):
        kind, yes = k % 4, k % 8 < 4
        if kind == 0:
            span = f"{name()}.{name()}{good((' at ', ' (at) ', '(at)', '[at]'))}{name()}mail{good((' dot ', '[dot]', '.'))}{good(('com', 'org', 'net'))}" if yes else f"{good(('meeting', 'shown', 'arrive', 'look', 'sold', 'held'))} at {good(('home', 'noon', 'work', 'rest'))}.{good(('The', 'it', 'txt', 'then'))}"
            lead = good(("mail me:", "contact", "write to", "e-mail", "")) if yes else good(("they were", "it was", "we will", ""))
        elif kind == 1:
            span = good((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")) if yes else good((f"{num(4)}-{num(4)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)}/{num(3)}"))
            lead = good(("call", "phone", "tel.", "mobile:", "my cell is", "")) if yes else good(("version", "pages", "order", "part", "isbn", "years", "about $", ""))
        elif kind == 2:
            span = f"{num(3)}-{num(2)}-{num(4)}"
            lead = good(("ssn", "social security number", "identity:", "security no.")) if yes else good(("order", "invoice", "part", "serial", "ref", "lot"))
        else:
            span = f"{good(('DE', 'FR', 'ES', 'GB'))}{num(2)} " + " ".join(num(4) for _ in range(4)) + f" {num(2)}" if yes else f"{good(('AB', 'SN', 'PX', 'ID'))}{num(2)}" + "".join(good(("QWER", "ASDF", "ZXCV", num(4))) for _ in range(3))
            lead = good(("iban", "account", "bank transfer to", "")) if yes else good(("serial", "model", "part", "ticket", ""))
        out.append((f"{filler()} {lead} {span} {filler()}.", yes))
    return out


def _grow(x: np.ndarray, target: np.ndarray, depth: int, least: int = 8) -> dict:
    """A regression tree by exact splits."""
    leaf = {"value": float(target.mean()) if len(target) else 0.0}
    if not depth or len(target) < 2 * least:
        return leaf
    best = (1e-9, None, None)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], target[order]
        sums = np.cumsum(t)[:-1]
        n = np.arange(1, len(t))
        gain = sums**2 / n + (t.sum() - sums) ** 2 / (len(t) - n) - t.sum() ** 2 / len(t)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = 0
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), j, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return {"feature": best[1], "at": best[2], "low": _grow(x[low], target[low], depth - 1, least), "high": _grow(x[~low], target[~low], depth - 1, least)}


def _value(tree: dict, x: np.ndarray) -> np.ndarray:
    if "value" in tree:
        return np.full(len(x), tree["value"])
    low = x[:, tree["feature"]] <= tree["at"]
    return np.where(low, _value(tree["low"], x), _value(tree["high"], x))


def fit(spark: SparkSession, labels: Iterable[tuple[str, bool]], trees: int = 24, depth: int = 3, rate: float = 0.4, precision: float = 0.97) -> tuple[list[dict], float, list[float]]:
    """Boosted trees, the first score, and the threshold of each kind."""
    rows = list(labels)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled texts")
    frame = proposals(spark.createDataFrame([(t, bool(y)) for t, y in rows], "text string, y boolean").coalesce(1))
    found = [(list(c.x), float(r.y)) for r in frame.select("more", "y").collect() for c in r.more]
    x, y = np.array([a for a, _ in found]), np.array([b for _, b in found])
    fold = np.arange(len(y)) % 2 == 0
    first = math.log((y[fold].mean() + 1e-3) / (1 - y[fold].mean() + 1e-3))
    score, forest = np.full(len(y), first), []
    for _ in range(trees):
        miss = y - 1 / (1 + np.exp(-score))
        # Newton's steps are about four times a mean residual near probability one half.
        tree = _grow(x[fold], 4 * rate * miss[fold], depth)
        forest.append(tree)
        score += _value(tree, x)
    p = 1 / (1 + np.exp(-score))
    thresholds = []
    for kind in range(len(MORE_KINDS)):
        mine = ~fold & (x[:, 0] == kind)
        order = np.sort(p[mine])
        fits = [t for t in order if y[mine & (p >= t)].mean() >= precision]
        thresholds.append(max(0.5, float(fits[0])) if fits else 1.1)
    return forest, first, thresholds


@lru_cache(maxsize=4)
def _default_model(application: str):
    return fit(SparkSession.active(), default_labels())


def _complete(tree: dict, depth: int) -> tuple[list[int], list[float], list[float]]:
    """Features and thresholds of a tree's inner nodes level by level, and its leaves, as if every branch were ``depth`` deep."""
    level, features, limits = [tree], [], []
    for _ in range(depth):
        below = []
        for node in level:
            features.append(node.get("feature", 0))
            limits.append(node.get("at", 0.0))
            below += [node.get("low", node), node.get("high", node)]
        level = below
    return features, limits, [node["value"] for node in level]


def score(x: Column, forest: list[dict], first: float, depth: int = 3) -> Column:
    """The forest's probability for an array of features."""
    trees = [_complete(t, depth) for t in forest]
    literal = F.array(*(F.struct(F.array(*map(F.lit, f)).alias("f"), F.array(*map(F.lit, t)).alias("t"), F.array(*map(F.lit, v)).alias("v")) for f, t, v in trees))

    def add(total: Column, tree: Column) -> Column:
        at, width = F.lit(0), 1
        for level in range(depth):
            node = at + (width - 1)
            at = at * 2 + (F.get(x, F.get(tree["f"], node)) > F.get(tree["t"], node)).cast("int")
            width *= 2
        return total + F.get(tree["v"], at)

    return 1.0 / (1.0 + F.exp(-F.aggregate(literal, F.lit(first), add)))


def _found(rows: DataFrame, keep: str, labels: Iterable[tuple[str, bool]] | None) -> DataFrame:
    """``keep`` and ``spans`` of rows with ``text``; each row is judged by its own text alone."""
    spark = rows.sparkSession
    forest, first, thresholds = _default_model(spark.sparkContext.applicationId) if labels is None else fit(spark, labels)
    proposed = proposals(rows.select(keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).select(keep, "base", "more")
    limit = F.array(*(F.lit(t) for t in thresholds))
    scored = F.transform("more", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c["x"], forest, first).alias("p")))
    passed = proposed.select(keep, "base", F.filter(scored, lambda c: c["p"] >= F.get(limit, c["kind"])).alias("passed"))
    better = lambda o, c: (o["start"] < c["end"]) & (o["end"] > c["start"]) & ((o["p"] > c["p"]) | ((o["p"] == c["p"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["kind"] < c["kind"])))))
    chosen = passed.select(keep, "base", F.filter("passed", lambda c: ~F.exists("passed", lambda o: better(o, c))).alias("chosen"))
    name = F.array(*(F.lit(k) for k in MORE_KINDS))
    # Proposals come by kind, then start, and so do what is chosen of them.
    extra = F.transform("chosen", lambda c: F.struct(F.get(name, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return chosen.select(keep, F.concat("base", extra).alias("spans"))


def find(docs: DataFrame, labels: Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end; ordered by kind, then start) of every document."""
    found = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", labels)
    # Written out, so that what is done with the spans doesn't repeat the expressions that make them.
    return stored(found, "pii-spans")


def redact(docs: DataFrame, mark: str = "*", labels: Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """``docs`` with every character of a found span replaced by ``mark``, a single character; other columns pass through.

    Spans are made and used in the same row, without a join, so rows that repeat a
    doc_id, or have none, are redacted each by its own text. Null text stays null,
    empty text empty; lengths never change; an empty table gives an empty result.
    """
    row = "_row"
    found = _found(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(row), "text"), row, labels)
    cover = lambda text, s: F.concat(F.substring(text, F.lit(1), s["start"].cast("int")), F.repeat(F.lit(mark), (s["end"] - s["start"]).cast("int")), F.substring(text, s["end"].cast("int") + 1, F.length(text)))
    own = F.col(row)
    return found.select(*((F.aggregate("spans", own[c].cast("string"), cover) if c == "text" else own[c]).alias(c) for c in docs.columns))
