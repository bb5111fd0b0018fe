"""Sparse vectors against a plain dictionary vectoriser; softmax boosting on held-out rows; stored models."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from casewright.operators import boosting, learning, training, vectors

FEATURES = "id long, features map<string,struct<num:double,str:string>>"


def plain(maps, train):
    name = lambda k, v: k if v[0] is not None else f"{k}={v[1]}"
    known = {n: i for i, n in enumerate(sorted({name(k, v) for m in train for k, v in m.items() if v != (None, None)}, key=str.encode))}
    return known, [sorted((known[name(k, v)], v[0] if v[0] is not None else 1.0) for k, v in m.items() if name(k, v) in known and v != (None, None)) for m in maps]


def test_vectors_equal_a_plain_vectoriser(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([(rng.choice([0.0, -1.5, 3.0]), None), (None, rng.choice(["x", "é", "", "Z"])), (None, None)])
    maps = [{k: value() for k in rng.sample(["a", "b", "a=x", "é", "zz"] + [f"n{j}" for j in range(40)], rng.randrange(8))} for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(maps)), FEATURES).repartition(6)
    names = vectors.vocabulary(rows.where("id < 120"))
    known, want = plain(maps, maps[:120])
    assert {r.name: r["index"] for r in names.collect()} == known
    got = {r.id: [(e["index"], e["value"]) for e in r.vector] for r in vectors.vectors(rows, "id", names).collect()}
    assert got == dict(enumerate(want)) and [] in got.values()


def test_indexes_over_many_ranges(spark):
    rows = spark.range(5000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    got = [r.name for r in vectors.indexed(rows.union(rows)).orderBy("index").collect()]
    assert got == sorted(f"name{k}" for k in range(5000))


def made(n, seed, kinds=3):
    """Classes by two numbers, one of which is often missing, and a sign that only class 2 has."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y = rng.normal(size=2)
        label = 2 if rng.random() < 0.2 else int(x > 0 and y > -0.7)
        vector = ([(0, float(x))] if rng.random() < 0.95 else []) + [(1, float(y))] + ([(2, 1.0)] if label == 2 else []) + [(3, float(rng.normal()))]
        out.append((k, f"c{label % kinds}", vector))
    return out


ROWS = "id long, label string, vector array<struct<index:long,value:double>>"


@pytest.mark.parametrize("kinds", [2, 3])
def test_boosting_beats_the_majority_on_held_out_rows(spark, kinds):
    train, test = (spark.createDataFrame(made(n, seed, kinds), ROWS).repartition(3) for n, seed in ((1500, 1), (600, 2)))
    model = boosting.fit(train, 4, rounds=5, depth=3, rate=0.5)
    found = boosting.score(test, model, ["id", "label"]).collect()
    right = sum(r.label == r.prediction for r in found) / len(found)
    most = max(sum(r.label == c for r in found) for c in model.classes) / len(found)
    assert len(found) == 600 and right > most + 0.25 and right > 0.85
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.prediction == model.classes[int(np.argmax(r.probabilities))] for r in found)
    scored = boosting.score(test, model, ["id"])
    assert boosting.check_scores(scored, model).count() == 0
    top = boosting.classified(scored, model, 2).first()
    assert [t.label for t in top.top] == [c for _, c in sorted(zip([-p for p in top.probabilities], model.classes, strict=True), key=lambda x: x[0])][:2] and len(boosting.classified(scored, model, 9).first().top) == kinds
    empty = spark.createDataFrame([(1, "x", []), (2, None, [(9, 1.0)])], ROWS)  # no features, an unknown one
    assert {r.prediction for r in boosting.score(empty, model, ["id"]).collect()} <= set(model.classes)


def test_split_sums_equal_a_plain_search(spark):
    """The first split of each class, on all rows and features, is the one a search over all cuts finds."""
    rows = made(400, 3)
    model = boosting.fit(spark.createDataFrame(rows, ROWS), 4, rounds=1, depth=1, row_share=1.1, column_share=1.1)
    bins = [{i: 1 + int(np.searchsorted(model.edges[i], v, "left")) for i, v in vector} for _, _, vector in rows]
    for c, tree in zip(model.classes, model.rounds[0], strict=True):
        g = np.array([1 / 3 - (label == c) for _, label, _ in rows])
        h = np.full(len(rows), 2 * (1 / 3) * (2 / 3))
        gain = lambda left: sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) if min(h[left].sum(), h[~left].sum()) >= 1 else -1  # noqa: E731, B023
        best = max(gain(np.array([(b[f] <= cut) if f in b else side for b in bins])) for f in range(4) for cut in range(1, 33) for side in (True, False))
        own = np.array([(b[tree.feature[0]] <= tree.cut[0]) if tree.feature[0] in b else bool(tree.absent_left[0]) for b in bins])
        assert gain(own) == pytest.approx(best)
        for leaf, side in enumerate((own, ~own)):
            assert tree.value[leaf] == pytest.approx(-0.3 * g[side].sum() / (h[side].sum() + 1.0))


def test_scores_that_break_the_contract_are_named(spark):
    model = boosting.Model(["a", "b"], {}, 0, 1)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5], "a"), (2, [0.5], "a"), (3, None, "a"), (4, [nan, 0.5], "a"), (5, [inf, 0.0], "a"), (6, [0.5, 0.6], "a"), (7, [-0.5, 1.5], "a"), (8, [0.5, 0.5], "c"), (9, [0.5, 0.5], None)]
    found = boosting.check_scores(spark.createDataFrame(rows, "id int, probabilities array<double>, prediction string"), model)
    assert {r.id: r.problem for r in found.collect()} == {2: "shape", 3: "shape", 4: "not_finite", 5: "not_finite", 6: "not_a_share", 7: "not_a_share", 8: "unknown_class", 9: "unknown_class"}


def test_one_class_cannot_be_trained(spark):
    with pytest.raises(ValueError, match="two classes"):
        boosting.fit(spark.createDataFrame([(1, "a", [(0, 1.0)])], ROWS), 1)


def test_a_stored_model_is_read_again_after_it_changed(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), float(k > 5)) for k in range(12)], "x double, label double")
    path = str(tmp_path / "m")
    uids = []
    for c in (0.1, 0.2):
        model = learning.detector(["x"], estimator=LogisticRegression(regParam=c)).fit(rows)
        training.save(model, path)
        assert training.loaded(path) is training.loaded(path)
        uids.append((model.uid, training.loaded(path).uid))
    assert uids[0][0] == uids[0][1] and uids[1][0] == uids[1][1] != uids[0][1]
