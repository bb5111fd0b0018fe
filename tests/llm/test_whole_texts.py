"""Operators do the whole job: texts, documents and pairs that a screen or filter once left out."""

from __future__ import annotations

import corpus_pipeline
from casewright.llm import decontam, secrets
from casewright.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"src{k % 7}", len(t)) for k, t in enumerate(texts)], DOCS)


def test_every_key_name_alone_is_scanned(spark):
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    names += [n.upper() for n in names] + [n.title() for n in names]
    texts = [f"my {n}{mid}abc123 ok" for n in names for mid in (":", "=", ": ", " = ", '": "', "' ='")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert got == {k: [("assign", 3, t.index("abc123") + 6)] for k, t in enumerate(texts)}


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_texts_shorter_than_the_item_are_compared(spark):
    item = [f"w{k}" for k in range(59)]
    texts = [item[:57], item[1:], item[:-1], item[:50], item[:40], item, ["x"] * 30 + item[:57], item[:57] + ["x"] * 30]
    found = decontam.find_leaks(docs_of(spark, [" ".join(t) for t in texts]), items_of(spark, [" ".join(item)])).collect()
    got = {r.doc_id: (r.start_word, r.end_word, round(r.similarity, 4)) for r in found}
    assert set(got) == {0, 1, 2, 3, 5, 6, 7}  # 36 of 55 shingles are too few, 46 are enough
    assert got[0] == (0, 57, round(53 / 55, 4)) and got[2] == (0, 58, round(54 / 55, 4)) and got[3] == (0, 50, round(46 / 55, 4))


def test_items_shorter_than_a_shingle_are_found_inside_texts(spark):
    texts = ["red green blue", "one two three Red green blue four five", "red green", "green blue red and red green", "red green blue red green blue", "a red green blue"]
    bench = items_of(spark, ["red green blue", "nothing here", "Red green blue"])
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.similarity) for r in decontam.find_leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(d, k): (s, s + 3, 1.0) for d, s in ((0, 0), (1, 3), (4, 0), (5, 1)) for k in (0, 2)}


def test_null_and_repeated_ids_are_documents_of_their_own(spark, data):
    item = table(spark, data, "benchmark").first().text
    text = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    line = lambda k: text(k, 6)
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(5)), (9, text(5)), (None, text(8)), (3, text(8)), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    of = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    left = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(5)), (3, text(8)), (None, item)]
    assert of(corpus_pipeline.minhash_dedup(spark, docs, data)) == sorted(left, key=str)
    assert of(corpus_pipeline.decontaminate(spark, docs, data)) == sorted(rows[:-1], key=str)
    bad = spark.createDataFrame([(None, "", "en", "s", 0), (None, text(1, 400), "en", "s", 0), (4, "", "en", "s", 0), (4, text(1, 400), "en", "s", 0)], DOCS)
    assert "" not in {r.text for r in corpus_pipeline.quality_rules(spark, bad, data).collect()}
    shared = [(1, line(1)), (5, line(1) + "\nfirst of its own"), (5, "second\n" + line(2)), (None, "words of its own\n" + line(1))] + [(10 + k, line(1)) for k in range(5)]
    lines = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(shared)], DOCS)
    got = of(corpus_pipeline.line_dedup(spark, lines, data))
    assert {(1, line(1)), (5, "first of its own"), (5, "second\n" + line(2)), (None, "words of its own")} <= set(got)


def test_documents_with_few_words_of_their_own_stay(spark, data):
    lines = "\n".join(" ".join(f"l{k}x{j}" for j in range(10)) for k in range(40))
    texts = [lines] * 6 + [f"{lines}\na note\n", f"short\n{lines}", ""]
    rows = [(k, t, "en", f"s{k}", len(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, DOCS), data).collect()}
    assert got == {0: lines, 6: "a note\n", 7: "short", 8: ""}  # 1 to 5 have no word left
