"""The source audit against its SQL, on the given tables and on ones of awkward make."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from compare import comparable, duck

from casewright.llm import divergence, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, ranks, prior=5, scale=10**9):
    """The audit in whole numbers over every group and kept term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs = [(TERM.findall(t.translate(FOLD)), s) for t, of, s in rows if of == lang]
        seen = Counter(w for words, _ in docs for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        counts = {}
        for words, s in docs:
            counts.setdefault(s, Counter()).update(w for w in words if seen[w] >= min_docs)
        share = lambda c: {w: 1 + scale * (c[w] + prior) // (sum(c.values()) + prior * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:ranks]
            out |= {(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)}
    return out


def found(frame):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("min_docs", [1, 3])
def test_audit_against_brute_force(spark, min_docs):
    texts = ["one two two THREE", "Two four été ÉTÉ", "four four-five 6six", "x" * 30_000 + " two", "", None, " 12 \t", "one two three four five", "日本 two 日本", "four"]
    rows = [(t, lang, f"s{(k * 7 + j) % 5}" if k % 6 else None) for j, lang in enumerate(("en", "fr", None, "")) for k, t in enumerate(texts * 3)]
    rows += [("lonely words", "xx", "only"), (None, "yy", "a"), ("", "yy", "b")]
    docs = spark.createDataFrame([(None, t, lang, s, None) for t, lang, s in rows], DOCS).selectExpr("*", "1 AS term", "1 AS n", "1 AS value", "1 AS base", "1 AS v")
    assert found(divergence.audit(docs, min_docs=min_docs, ranks=4)) == brute(rows, min_docs, 4)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_many_tied_terms_and_a_hot_source(spark):
    rows = [(" ".join(f"tie{chr(97 + (k * 7 + j) % 26)}{chr(97 + j % 26)}" for j in range(90)), "en", "hot" if k % 3 else f"s{k % 9}") for k in range(150)]
    docs = spark.createDataFrame([(k, t, lang, s, None) for k, (t, lang, s) in enumerate(rows)], DOCS)
    assert found(divergence.audit(docs, min_docs=30, ranks=50)) == brute(rows, 30, 50)


def test_query_against_its_oracle(spark, data):
    got = queries.op11_source_divergence(spark, data).toPandas()
    assert comparable(got) == comparable(duck(data).sql(queries.oracle_sql()["op11_source_divergence"]).df()) and len(got) > 500
