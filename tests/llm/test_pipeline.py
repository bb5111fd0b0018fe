"""The pipeline's stages: columns, decisions, and clean documents that stay."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import comparable
from test_llm_operators import FOLD, WORD, _components, _least_determinant, _sets

from casewright.llm import decontam, linedup, mixing, neardup, quality
from casewright.session import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def staged(spark, data):
    """Input and output of every stage."""
    docs, out = table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, data).cache()
        out[name] = (docs, found)
        docs = found
    return out


def test_columns_and_order(staged, spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "decontaminate", "mix_sources"]
    columns = table(spark, data, "documents").columns
    assert all(out.columns == columns for name, (_, out) in staged.items() if name != "mix_sources")


def test_decisions_take_effect(staged, spark, data):
    before, after = staged["quality_rules"]
    good = {r.doc_id for r in quality.judge(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = staged["line_dedup"]
    want = {r.doc_id: r.text for r in linedup.dedup_lines(before).collect()}
    assert all(want[r.doc_id] == r.text and len(r.text) == r.n_chars for r in after.collect())
    before, after = staged["minhash_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
    before, after = staged["decontaminate"]
    leaks = {r.doc_id for r in decontam.find_leaks(before, table(spark, data, "benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaks


def test_run_equals_the_stages(staged, spark, data):
    assert sorted(corpus_pipeline.run(spark, data).collect()) == sorted(staged["mix_sources"][1].collect())


def test_empty_and_null_rows(spark, data):
    schema = table(spark, data, "documents").schema
    for rows in ([], [(None,) * 5, (1, "", "en", "s", 0), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        docs.collect()


def _kept_by_quality(rows):
    """Base rule and distances of every cell, in numpy; the statistic vectors are the operator's."""
    x = {r.doc_id: np.array([r[c] for c in quality.STATS]) for r in rows if not r.base_failed}
    where = {r.doc_id: (r.lang, r.source) for r in rows}
    variance = np.var(list(x.values()), axis=0)
    groups, languages = Counter(where[k] for k in x), Counter()
    for k in x:
        languages[where[k][0]] += groups[where[k]] < 100
    cell = {k: where[k] if groups[where[k]] >= 100 else where[k][0] if languages[where[k][0]] >= 100 else "rest" for k in x}
    members = defaultdict(list)
    for k in x:
        members[cell[k]].append(k)
    found = {c: _least_determinant(np.array([x[k] for k in ids]), variance) for c, ids in members.items()}
    distance = {k: d for c, ids in members.items() for k, d in zip(ids, found[c][0], strict=True)}
    if 0 < len(members["rest"]) < 100:
        cores = np.array([x[k] for c, ids in members.items() for k, inside in zip(ids, found[c][1] if ids else [], strict=True) if inside])
        p = len(quality.STATS)
        wide = quality.chi_square_quantile(0.975, p)
        scatter = np.cov(cores.T, bias=True) * 0.975 / quality.chi_square_below(wide, p + 2)
        for k in members["rest"]:
            distance[k] = float((x[k] - cores.mean(0)) @ np.linalg.solve(scatter, x[k] - cores.mean(0)))
    limit = quality.t_quantile(0.999, len(quality.STATS), 6.0)
    assert all(abs(d - limit) > 1e-3 * limit for d in distance.values())  # no verdict hangs on rounding
    return {k for k, d in distance.items() if d <= limit}


def _without_boilerplate(texts, sites):
    """Texts without lines of three words or more that are on five sites, but in the first document; emptied ones go."""
    spread, first = defaultdict(set), {}
    for k in sorted(texts):
        for line in texts[k].split("\n"):
            if len(WORD.findall(line)) >= 3:
                spread[line].add(sites[k] or "")
                first.setdefault(line, k)
    gone = {line for line, s in spread.items() if len(s) >= 5}
    out = {k: "\n".join(line for line in t.split("\n") if line not in gone or first[line] == k) for k, t in texts.items()}
    return {k: t for k, t in out.items() if t == texts[k] or WORD.search(t)}


def _leaking(texts, items):
    """Documents with a window that an item resembles by 0.8 or more, every window compared."""
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    words = lambda t: WORD.findall(t.translate(FOLD))
    listed = [(len(words(t)), grams(words(t))) for t in items]
    df = Counter(g for _, s in listed for g in s)
    weight = lambda g: np.log(1 + len(items) / df.get(g, 1))
    found = set()
    for k, t in texts.items():
        w = words(t)
        have = grams(w) if w else Counter()
        for n, theirs in listed:
            if not have.keys() & theirs.keys():
                continue
            for i in range(max(1, len(w) - n + 1)):
                mine = grams(w[i : i + n])
                if mine.keys() & theirs.keys() and sum(weight(g) * min(mine[g], theirs[g]) for g in mine | theirs) >= 0.8 * sum(weight(g) * max(mine[g], theirs[g]) for g in mine | theirs):
                    found.add(k)
                    break
    return found


def test_run_against_brute_force(spark, data):
    docs = table(spark, data, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    good = _kept_by_quality(quality.with_base(quality.statistics(docs)).withColumns(quality.transformed()).collect())
    texts = _without_boilerplate({k: rows[k].text for k in good}, {k: rows[k].source for k in good})
    ids = sorted(texts)
    component = _components(_sets([texts[k] for k in ids], 5), 80)
    texts = {ids[k]: texts[ids[k]] for k, c in enumerate(component) if k == c}
    leaks = _leaking(texts, [r.text for r in table(spark, data, "benchmark").collect()])
    assert len(good) < len(rows) and len(ids) > len(texts) and leaks
    left = pd.DataFrame([(k, t, rows[k].lang, rows[k].source, len(t)) for k, t in texts.items() if k not in leaks], columns=docs.columns)
    con = duckdb.connect()
    con.register("documents", left)
    assert comparable(corpus_pipeline.run(spark, data).toPandas()) == comparable(con.sql(mixing.sql()).df())


def test_extra_columns_with_clashing_names_pass_through(spark, data):
    docs = table(spark, data, "documents")
    names = ("_row", "_bad", "_id", "_gone", "_leaked", "_of", "kept", "places", "component_id", "cell", "_hash")
    wide = docs.selectExpr("*", *(f"doc_id + {k} AS {n}" for k, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, data).collect()
        assert all(r[n] == r.doc_id + k for r in found for k, n in enumerate(names)), name
        assert {r.doc_id for r in found} == {r.doc_id for r in stage(spark, docs, data).collect()}, name
