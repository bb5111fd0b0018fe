"""Sparse vectors by a vocabulary: numbers by their name, texts as ``name=value`` with 1; names unknown to the vocabulary are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import stored


def entries(features: Column) -> Column:
    """Name and number of each entry of a map of (num, str) values; entries with neither are left out."""
    named = F.transform(F.map_entries(features), lambda e: F.struct(F.when(e["value"]["num"].isNotNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]["str"])).alias("name"), F.coalesce(e["value"]["num"], F.lit(1.0)).alias("value")))
    return F.filter(named, lambda e: e["name"].isNotNull())


def indexed(names: DataFrame, column: str = "name") -> DataFrame:
    """``column`` and ``index``: the place of each distinct name in the order of all, from 0.

    Names are dealt into ranges of even size; ranges are counted, and names numbered inside of
    theirs, so no task holds more than its range.
    """
    ranges = stored(names.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "vocabulary-ranges")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranges.withColumn("_k", inside).join(starts, "_part").select(column, (F.col("_start") + F.col("_k") - 1).alias("index"))


def vocabulary(rows: DataFrame, features: str = "features") -> DataFrame:
    """name and index of all entries of ``rows``."""
    return stored(indexed(rows.select(F.explode(entries(F.col(features))).alias("e")).select("e.name")), "vocabulary")


def vectors(rows: DataFrame, key: str, names: DataFrame, features: str = "features") -> DataFrame:
    """``key`` and ``vector``, an array of (index, value) in order; rows without a known name have an empty one. ``key`` is unique."""
    long = rows.select(key, F.explode(entries(F.col(features))).alias("e")).select(key, "e.name", "e.value")
    met = long.join(names, "name").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("vector"))
    none = F.array().cast("array<struct<index:bigint,value:double>>")
    return rows.select(key).join(met, key, "left").withColumn("vector", F.coalesce("vector", none))
