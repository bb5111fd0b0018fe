"""Radix selection against plain sorting, with ties, long common prefixes, one hot group and every kind of double."""

from __future__ import annotations

import math
import random
import struct

import pytest

from casewright.operators import radix


def plain_top(rows, k):
    groups = {}
    for g, item, value in rows:
        if item is not None and value is not None:
            groups.setdefault(g, []).append((-value, item.encode(), item))
    return {(g, rank, item, -value) for g, members in groups.items() for rank, (value, _, item) in enumerate(sorted(members)[:k], 1)}


@pytest.mark.parametrize("small", [1, 4096])
def test_top_of_groups(spark, small):
    rng = random.Random(small)
    rows = [("hot", f"t{k}", rng.choice([7, 70_000, 5_000_000_000, rng.randrange(1 << 40)])) for k in range(1500)]
    rows += [("ties", "x" * rng.randrange(40) + f"é{k:03d}"[: rng.randrange(1, 5)] + str(k), 3) for k in range(600)]
    rows += [("negative", f"n{k}", rng.randrange(-(1 << 62), 1 << 62)) for k in range(100)] + [("few", "only", 1), (None, "a", 2), (None, "", 2), (None, "ab", 2)]
    rows += [("prefixes", "p" * k, 9) for k in range(200)] + [("few", None, 5), ("few", "null", None)]
    frame = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 50):
        got = {(r.g, r["rank"], r["item"], r["value"]) for r in radix.top(frame, ["g"], "value", "item", k, small).collect()}
        assert got == plain_top(rows, k)
    assert radix.top(frame.limit(0), ["g"], "value", "item", 3).collect() == []


def test_bits_of_doubles_keep_order_and_come_back(spark):
    rng = random.Random(5)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1.0, math.nextafter(1, 0), math.nextafter(1, 2)]
    values += [math.nextafter(2.0**k, side) for k in range(-1070, 1020, 7) for side in (0, math.inf)] + [2.0**k for k in range(-1074, 1024)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("b", radix.ordered_bits("v")).withColumn("back", radix.from_bits("b")).collect()
    for r in rows:
        assert r.back == r.v or (math.isnan(r.v) and math.isnan(r.back))
    kept = sorted((r for r in rows if not math.isnan(r.v)), key=lambda r: r.b)
    assert all(a.v < b.v if a.b < b.b else a.v == b.v for a, b in zip(kept, kept[1:], strict=False))
    assert all(r.b > kept[-1].b for r in rows if math.isnan(r.v))


def test_places_of_values(spark):
    rng = random.Random(2)
    values = {"a": [rng.randrange(1 << 50) for _ in range(300)], "b": [4] * 9 + [1]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v long")
    wanted = spark.createDataFrame([("a", 1), ("a", 7), ("a", 300), ("b", 9), ("b", 10)], "g string, place long")
    got = {(r.g, r.place): (r.v, r.need, r.n) for r in radix.kth(rows, ["g"], "v", wanted).collect()}
    for (g, place), (v, need, n) in got.items():
        ordered = sorted(values[g], reverse=True)
        assert v == ordered[place - 1] and n == ordered.count(v) and need == place - ordered.index(v)
    assert len(got) == 5
