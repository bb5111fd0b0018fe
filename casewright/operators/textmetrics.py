"""Text operators: tokens, ROUGE-L, TF-IDF cosine, JSON extraction and the assignment scrubber."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.leak import has_target_text
from casewright.session import spread, stored

from . import payloads

#: Marked letters and their plain forms, for the expression that stays in the JVM.
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text, marks taken off."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit("[a-z0-9]+"), 0)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_nfkd(text: pd.Series) -> pd.Series:
    """The same by Unicode decomposition, for any script."""

    def one(value: str | None) -> list[str]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
        return re.findall("[a-z0-9]+", plain.casefold())

    return text.map(one)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows: one big-integer step for each token of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(left: pd.Series, right: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token lists; 0 if either is empty."""

    def one(a, b) -> float:
        a, b = list(a if a is not None else ()), list(b if b is not None else ())
        common = lcs_length(a, b)
        return 2.0 * common / (len(a) + len(b)) if common else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def tfidf_cosine(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, cosine) of the two texts of each pair; idf = ln((1 + n) / (1 + df)) + 1 over all texts of both sides, tokens of two characters or more.

    Texts are dealt by key once, over all tasks, so their tokens are counted where they are; the
    counts are written out, and what the tokens' weights join is one narrow row
    for each text and token. Spark broadcasts the vocabulary if it measures small.
    """
    side = lambda column, is_left: F.transform(F.filter(tokens(F.col(column)), lambda t: F.length(t) >= 2), lambda t: F.struct(t.alias("token"), F.lit(is_left).alias("is_left")))
    dealt = spread(pairs.select(key, left, right), key)
    exploded = dealt.select(key, F.explode(F.concat(side(left, True), side(right, False))).alias("t")).select(key, "t.token", "t.is_left")
    counts = stored(exploded.groupBy(key, "token").agg(F.count_if("is_left").alias("a"), F.count_if(~F.col("is_left")).alias("b")), "tfidf-counts")
    n_texts = pairs.agg((F.count(F.lit(1)) * 2).alias("n_texts"))
    df = counts.groupBy("token").agg((F.count_if(F.col("a") > 0) + F.count_if(F.col("b") > 0)).alias("df"))
    idf = stored(df.crossJoin(F.broadcast(n_texts)).select("token", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf")), "tfidf-vocabulary")  # one row
    square = F.col("idf") * F.col("idf")
    sums = counts.join(idf, "token").groupBy(key).agg(F.sum(F.col("a") * F.col("b") * square).alias("dot"), F.sum(F.col("a") * F.col("a") * square).alias("aa"), F.sum(F.col("b") * F.col("b") * square).alias("bb"))
    return sums.select(key, F.coalesce(F.try_divide("dot", F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("cosine"))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two token lists as sets; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


_BRACES = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.DOTALL)


@F.pandas_udf(T.StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    """From the first brace of a text to the one that closes it, braces in strings aside; null if none does."""

    def one(value: str) -> str | None:
        depth, start = 0, value.find("{")
        for m in _BRACES.finditer(value, max(start, 0)):
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if depth == 0:
                return value[start : m.end()]
        return None

    return text.map(one, na_action="ignore")


def json_object(text: Column) -> Column:
    """The object that a text is, a fence around it aside, or else the first balanced one in it, as a variant.

    Null if there is none, if that one doesn't parse, or if the whole text is
    another JSON value. Only texts that are no JSON themselves go to Python.
    """
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, "^`+|`+$", ""), r"^(?i:json)\s*", "")).otherwise(bare)
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(balanced_object(F.when(whole.isNull() & bare.contains("{"), bare)))
    return F.when(whole.isNotNull(), F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole)).otherwise(inner)


def tidied(text: Column) -> Column:
    """A text without what removed assignments leave around them, in the JVM."""
    single = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(single, payloads.PARTS_NOTHING, ""), payloads.ENDS, "")


@F.pandas_udf(T.StringType())
def without_assignments(text: pd.Series) -> pd.Series:
    """Texts without target assignments and their values."""
    return text.map(lambda t: payloads.ASSIGNMENT.sub("", t), na_action="ignore")


def scrub_text(text: Column) -> Column:
    """A text without target assignments; JSON texts are cleaned as payloads. Null stays null.

    Only JSON texts and texts with an assignment go to Python; all are tidied in the JVM.
    """
    is_json = F.coalesce(text.rlike(r"^\s*[{\[]"), F.lit(False)) & F.try_parse_json(text).isNotNull()
    plain = F.when(has_target_text(text), without_assignments(F.when(has_target_text(text) & ~is_json, text))).otherwise(text)
    return F.when(is_json, payloads.sanitized(F.when(is_json, text), payloads.KEYS_ONLY)).otherwise(tidied(plain))


scrub = payloads.scrub  # the same for one string
