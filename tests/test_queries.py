"""Every registered query of the library: against its oracle, or at least runs."""

from __future__ import annotations

import re

import pytest
from compare import comparable, duck

from casewright.operators import learning, textmetrics
from casewright.plans import registry
from casewright.session import table

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


def test_inventory():
    assert len(QUERIES) >= 150
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"split_matrix", "exact_split", "rouge_l", "scrub_text", "ml_scores", "train_metrics", "model_artifact", "boosted_classes"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    found = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert comparable(found) == comparable(con.sql(ORACLES[name]).df())
    else:
        assert len(found)


# Queries without SQL, against plain Python on the same tables


def test_rouge_l_against_plain_python(spark, data):
    docs, items = table(spark, data, "documents").collect(), {r.item_id: r.text for r in table(spark, data, "benchmark").collect()}
    plain = str.maketrans(textmetrics.MARKED, textmetrics.PLAIN)
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower().translate(plain))
    got = {r.doc_id: r.f1 for r in QUERIES["rouge_l"](spark, data).collect()}
    for r in docs[:60]:
        a, b = tokens(r.text), tokens(items[r.doc_id % len(items)])
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b):
                row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
        assert got[r.doc_id] == pytest.approx(2 * row[-1] / (len(a) + len(b)) if a and b else 0, abs=1e-6)


def test_exact_split_meets_the_matrix(spark, data):
    matrix = {(r["class"], r.origin, r.part): r.quota for r in QUERIES["split_matrix"](spark, data).collect()}
    cells = {(r["class"], r.origin, r.part): r.n for r in QUERIES["exact_split"](spark, data).collect()}
    assert {k: v for k, v in matrix.items() if v} == cells
    counts = {}
    for (label, origin, _), n in cells.items():
        counts.setdefault(label, {}).setdefault(origin, 0)
        counts[label][origin] += n
    for label, rows in counts.items():
        for part, units in zip(("train", "val", "test"), (14, 3, 3), strict=True):
            whole = sum(matrix.get((label, o, part), 0) for o in rows)
            assert abs(whole - sum(rows.values()) * units / 20) < 1
            assert all(abs(matrix.get((label, o, part), 0) - n * units / 20) < 1 for o, n in rows.items())


def test_models_score_every_row_and_come_back_the_same(spark, data):
    artifact = QUERIES["model_artifact"](spark, data).first()
    assert artifact.same and artifact.hashed and artifact.n_files > 3 and artifact.n > 0
    assert learning.check_scores(QUERIES["ml_scores"](spark, data)).count() == 0
    report = QUERIES["train_metrics"](spark, data).collect()
    assert {r.split for r in report} == {"train", "val", "test"} and all(r.tp + r.fn == r.tn + r.fp for r in report)


def test_boosted_classes_beat_the_majority(spark, data):
    cells = {(r.label, r.prediction): r.n for r in QUERIES["boosted_classes"](spark, data).collect()}
    total, truth = sum(cells.values()), {}
    for (label, _), n in cells.items():
        truth[label] = truth.get(label, 0) + n
    assert sum(n for (a, b), n in cells.items() if a == b) / total > max(truth.values()) / total + 0.25
