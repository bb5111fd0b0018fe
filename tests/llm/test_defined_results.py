"""What each operator's docstring defines for nulls, empty and repeated rows, ties, empty tables and clashing names."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import decontam, hmm, langid, mixing, neardup, pii, quality, queries, secrets, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = " ".join(f"word{k} plain" for k in range(60))


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def rows(spark):
    """Nulls in every column, an empty, a blank and a repeated row."""
    listed = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, PLAIN, None, None), (4, PLAIN, None, None), (None, PLAIN + " end", "en", "b"), (6, PLAIN + " token=abcdef1 a@b.cd", "fr", None)]
    return frame_of(spark, listed)


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://a.net/x"), (3, "http://a.net/x"), (None, "http://b.org/fr/1")], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()), key=str)
    own = {r[0]: r[4] for r in got if r[3] is None}
    assert set(own) == {1, 2} and set(own.values()) <= {"block", "allow"}
    assert [r for r in got if r[3] is not None] == sorted([(3, "a.net", "/x", "net/", "block")] * 2 + [(None, "b.org", "/fr/1", "org/fr/", "allow")], key=str)
    assert [r[1:3] for r in got if r[0] in (1, 2)] == [("", "")] * 2


def test_decontamination(spark, rows):
    items = spark.createDataFrame([(1, PLAIN), (1, PLAIN), (2, None), (3, " "), (None, PLAIN), (5, "word1 plain")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(rows, items).collect())
    assert got == {(4, 1): 2, (4, 5): 2, (None, 1): 1, (None, 5): 1, (6, 1): 1, (6, 5): 1}
    none = items.limit(0)
    assert decontam.find_leaks(rows, none).count() == 0 and decontam.decontaminate(rows, none).count() == 7


def test_quality(rows):
    got = by_id(quality.judge(rows))
    assert all((r.n_words, r.word_chars, r.n_dup_lines, r.base_failed, r.kept) == (0, 0, 0, True, False) for k in (1, 2, 3) for r in got[k])
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0].lang is None and not got[4][0].base_failed and got[4][0].distance is not None


def test_secrets(rows):
    got = by_id(secrets.scan(rows))
    assert all(r.spans == [] for k in (1, 2, 3, 4) for r in got[k]) and len(got[4]) == 2 and len(got[None]) == 1
    start = len(PLAIN) + 1
    assert [tuple(s) for s in got[6][0].spans] == [("assign", start, start + 13)]


def test_mixing(rows):
    got = by_id(mixing.mix(rows, portion=3.0))
    assert {(r.lang, r.source) for r in got[4]} == {("?", "?")} and len(got[4]) == 2
    assert all(r.n_tokens == 0 and r.copies >= 1 for k in (1, 2, 3) for r in got[k])  # no words fit into any rest
    assert mixing.mix(rows, portion=0.0).where("n_tokens > 0").count() == 0


def test_near_duplicates(rows):
    got = by_id(neardup.near_duplicates(rows))
    assert all((r.n_shingles, r.component_id, r.kept) == (0, k, True) for k in (1, 2, 3) for r in got[k])
    assert [(r.component_id, r.kept) for r in got[4]] == [(4, True)] * 2 and (got[None][0].component_id, got[None][0].kept) == (None, True)
    assert (got[6][0].component_id, got[6][0].kept) == (4, False)


def test_languages(spark, rows):
    got = by_id(langid.identify(rows, epochs=1))
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for k in (1, 2, 3) for r in got[k])
    assert got[4][0] == got[4][1] and got[4][0].lang_pred in ("en", "fr")
    unlabelled = rows.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}


def test_personal_data(rows):
    got = by_id(pii.find(rows))
    assert all(r.spans == [] for k in (1, 2, 3, 4) for r in got[k]) and len(got[4]) == 2
    assert [s.kind for s in got[6][0].spans] == ["email"]


def test_redaction_judges_each_row_by_its_own_text(spark):
    rows = [(1, "mail me: bob.a@x.org now", "en", "a"), (1, "call +1 212 555 0199 or write", "en", "a"), (1, "nothing", None, None), (None, "mail bob@x.org", None, "b"), (None, None, None, None), (2, "", "en", "a"), (2, "", "en", "a")]
    docs = frame_of(spark, rows).selectExpr("*", "'s' AS spans", "1 AS base", "2 AS more", "3 AS row")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    texts = sorted(((r.doc_id, r.text, r.row) for r in got.collect()), key=str)
    assert texts == sorted([(1, "mail me: " + "*" * 11 + " now", 3), (1, "call " + "*" * 15 + " or write", 3), (1, "nothing", 3), (None, "mail " + "*" * 9, 3), (None, None, 3), (2, "", 3), (2, "", 3)], key=str)


def test_decontamination_by_row(spark):
    item = " ".join(f"item{k} word{k}" for k in range(30))
    rows = [(None, f"before {item} after", "en", "a"), (2, "clean words of its own", "en", "a"), (2, item, "en", "b"), (2, None, None, None), (None, "clean too", None, None), (None, "", None, None), (3, item, "en", "a"), (3, item, "en", "a")]
    docs = frame_of(spark, rows).withColumn("_leaked", F.lit(1))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.decontaminate(docs, items)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == {(2, "clean words of its own"): 1, (2, None): 1, (None, "clean too"): 1, (None, ""): 1}


def test_held_out_is_false_without_an_id(spark, tmp_path):
    frame_of(spark, [(k if k else None, f"some words in a text {k}", "en", "a") for k in range(12)]).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (queries.op7_language_id, queries.op9_lm_score):
        assert {r.held_out for r in query(spark, str(tmp_path)).collect() if r.doc_id is None} == {False}


def test_language_model(spark, rows):
    got = by_id(hmm.score(rows, F.col("doc_id") == 6, own=7, buckets=5))
    assert all((r.n_tokens, r.n_known) == (1, 1) for k in (1, 2, 3) for r in got[k])
    assert got[4][0] == got[4][1] and not got[None][0].held_out and got[6][0].held_out
    untrained = hmm.score(rows, F.lit(True), own=7, buckets=5).collect()
    assert len(untrained) == 7 and all((r.train_tokens, r.n_known) == (0, 0) and r.score < 0 and r.base_score == 0 for r in untrained)


def test_empty_tables_pass_through_the_pipeline_with_clashing_names(spark, data):
    empty = frame_of(spark, []).withColumns({c: F.lit(1) for c in ("_row", "kept", "places", "cell", "_id", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, empty, data)
        assert found.columns == empty.columns and found.count() == 0, name
    assert corpus_pipeline.mix_sources(spark, empty, data).count() == 0
