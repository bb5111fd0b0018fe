"""Canonical encodings and digests of flat rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(values: Column) -> Column:
    """JSON of a flat map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def pipeline_hash(contract: dict[str, str]) -> str:
    """SHA-256 of the canonical JSON of a versioned contract."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row_digest(values: Column) -> Column:
    """First 16 bytes, in hexadecimal, of the SHA-256 of the sorted ``key=value`` pairs joined by a bar."""
    pairs = F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.left(F.sha2(F.array_join(F.array_sort(pairs), "|"), 256), F.lit(32))


def fingerprint(pairs: dict[str, Column]) -> Column:
    """SHA-256 of typed values in the order of their names; numbers as scaled whole numbers, so engines agree."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("~"))) for name, value in sorted(pairs.items())]
    return F.sha2(F.concat_ws("|", *parts), 256)


def feature_fingerprint(features: Column) -> Column:
    """SHA-256 of a feature map (num, str): keys in order, numbers by their double value, texts as they are.

    1, 1.0 and true have one encoding, 0.0 and -0.0 have two.
    """
    encode = lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"]["num"].isNotNull(), F.concat(F.lit("n"), e["value"]["num"].cast("string"))).otherwise(F.concat(F.lit("s"), F.coalesce(e["value"]["str"], F.lit("")))))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(features), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), encode), "|"), 256)
