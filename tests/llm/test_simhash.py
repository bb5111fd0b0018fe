"""SimHash near-duplicates against brute force over all pairs, and their defined results."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from casewright.llm import simhash
from casewright.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text, width=3):
    words = WORD.findall((text or "").translate(FOLD))
    parts = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """The least id reachable, for a list of (id, print); rows of one id are one node."""
    ids = [i for i, _ in prints]
    bits = np.array([p for _, p in prints], dtype=np.uint64)
    label = dict(zip(ids, ids, strict=True))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= radius) + k + 1:
            a, b = sorted((root(ids[k]), root(ids[j])))
            label[b] = a
    return {i: root(i) for i in ids}


def signed_long(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_against_plain_python(spark, data):
    texts = [r.text for r in table(spark, data, "documents").select("text").collect()]
    texts += [None, "", " \n\t ", "Word", "two Words", "One two  three", "ÀÉ ÀÉ àé", "a b " * 700, "x" * 5000, "same same same same", "\x0bone\x0ctwo\x1fthree"]
    got = simhash.fingerprints(pa.array(texts, pa.string()), 3)
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_components_of_dense_clusters_and_chains(spark, radius):
    """Random prints, chains of far ends, dense clusters about one print, and the edge of the radius."""
    rng = random.Random(radius)
    flip = lambda x, n: x ^ sum(1 << k for k in rng.sample(range(64), n))
    prints = {rng.getrandbits(64) for _ in range(400)}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(30):
            prints.add(at)
            at = flip(at, rng.randint(max(1, radius - 1), radius + 1))
    centre = rng.getrandbits(64)
    prints |= {flip(centre, rng.randint(0, 4)) for _ in range(300)}
    prints |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1, *(flip(0, radius) for _ in range(20)), *(flip((1 << 64) - 1, radius + 1) for _ in range(20))}
    listed = sorted(prints)
    rng.shuffle(listed)
    nodes = spark.createDataFrame([(k, signed_long(p)) for k, p in enumerate(listed)], "node long, print long")
    found = simhash.components(simhash.links(nodes, radius)).collect()
    got = {r.node: r.component for r in found}
    want = brute_components(list(enumerate(listed)), radius)
    assert {k: got.get(k, k) for k in want} == want


def test_the_lower_bound_never_passes_the_distance(spark):
    rng = random.Random(9)
    pairs = [(x, x ^ sum(1 << k for k in rng.sample(range(64), n))) for n in range(0, 9) for x in (rng.getrandbits(64) for _ in range(40))]
    rows = spark.createDataFrame([(signed_long(a), signed_long(b)) for a, b in pairs], "a long, b long")
    for (a, b), r in zip(pairs, rows.selectExpr(f"bit_count({simhash.embedded('a')} ^ {simhash.embedded('b')}) AS bound").collect(), strict=True):
        counts = [sum(abs((a >> k & 1) + (a >> k + 1 & 1) - (b >> k & 1) - (b >> k + 1 & 1)) for k in range(0, 64, 2))]
        assert r.bound == counts[0] <= (a ^ b).bit_count()


def test_query_against_brute_force(spark, data):
    from casewright.llm import queries

    docs = table(spark, data, "documents").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash_dedup(spark, data).collect()}
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = brute_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}
    assert len({c for _, c in got.values()}) < len(docs)


def test_defined_results(spark):
    long_text = " ".join(f"w{k} v{k % 7}" for k in range(3000))
    rows = [(5, None), (2, ""), (9, " \t"), (3, long_text), (4, long_text + " end"), (None, long_text), (7, "one two"), (7, long_text), (8, "ONE  two"), (8, "ONE  two"), (11, "else where now")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).selectExpr("*", "1 AS print", "1 AS node", "1 AS n_copies", "1 AS component")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_components([(i, p) for i, p in prints if i is not None])
    assert got == sorted(((i, f"{p:016x}", want.get(i)) for i, p in prints), key=str)
    assert want[9] == 2 and want[8] == want[7] == 3
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
