"""Selection of the k-th value of each group by radix: histograms over digits instead of sorted groups.

A value is a long. Its digits of 16 bits are looked at from the highest bit that differs; a pass counts
each group's rows by digit (a sum that merges before the shuffle), finds the digit
that holds the wanted place and goes on inside of it. So no task ever sorts
a group: a pass works on at most 65,536 counts of each, whatever the distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import stored

DIGIT = 16


def ordered_bits(x: str) -> Column:
    """A long that orders as the double ``x`` does: exponent above, 52 bits of fraction below, negated for negative values.

    -0.0 counts as 0.0 and NaN comes after infinity. Powers of two and products
    with them are exact, and the exponent that a logarithm gives is put right by a step either way.
    """
    rough = f"greatest(floor(log2(abs({x}))), -1022)"
    e = f"({rough} - if(pow(2D, {rough}) > abs({x}) and {rough} > -1022, 1, 0) + if({rough} < 1023 and pow(2D, {rough} + 1) <= abs({x}), 1, 0))"
    size = f"(({e} + 1022) * 4503599627370496 + cast(abs({x}) * pow(2D, -{e}) * 4503599627370496 as bigint))"
    return F.expr(f"case when {x} is null then null when isnan({x}) then 9218868437227405313 when {x} = 0 then 0 when abs({x}) = double('infinity') then 9218868437227405312 * cast(sign({x}) as bigint) else cast(sign({x}) as bigint) * {size} end").cast("long")


def from_bits(b: str) -> Column:
    """The double whose ``ordered_bits`` is ``b``."""
    e, m = f"shiftright(abs({b}), 52)", f"(abs({b}) & 4503599627370495)"
    value = f"if({e} = 0, {m} * pow(2D, -1074), ({m} + 4503599627370496) * pow(2D, -52) * pow(2D, {e} - 1023))"
    return F.expr(f"case when {b} is null then null when {b} = 9218868437227405313 then double('nan') when abs({b}) = 9218868437227405312 then sign({b}) * double('infinity') else sign({b}) * {value} end")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def kth(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame, weight: str | None = None) -> DataFrame:
    """keys, place, ``value``, need, n: the value at each wanted place of a group, counted from the greatest.

    ``wanted`` has the keys and ``place`` (from 1, no more than the group has rows).
    n rows of the group have the value; the ``need``-th of them is at the place. A row stands for as many as ``weight`` says, if it is given.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    low, high = rows.agg(F.min(value), F.max(value)).first()
    # The first digit begins at the highest bit that differs, so that it parts the values as finely as it can.
    span = 0 if low is None else 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    shifts = range(span - DIGIT, 0, -DIGIT)
    at = wanted.select(*keys, "place", F.col("place").alias("need"), F.lit(0).cast("long").alias("_prefix"))
    above = None
    for shift in [*shifts, 0]:
        prefix = F.lit(0).cast("long") if above is None else F.shiftright(F.col(value), above)
        open_ = rows.select(*keys, *([weight] if weight else []), prefix.alias("_prefix"), F.shiftright(F.col(value), shift).alias("_digit"))
        if above is not None:
            held = at.select(*keys, "_prefix").distinct()
            open_ = open_.join(held, same(open_, held, [*keys, "_prefix"]), "left_semi")
        counts = open_.groupBy(*keys, "_prefix", "_digit").agg(amount.alias("n"))
        counts = counts.withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys, "_prefix").orderBy(F.desc("_digit"))))
        found = at.join(counts, same(at, counts, [*keys, "_prefix"]) & (at["need"] > counts["_upto"] - counts["n"]) & (at["need"] <= counts["_upto"]))
        at = stored(found.select(*(at[k] for k in keys), at["place"], (at["need"] - (counts["_upto"] - counts["n"])).alias("need"), counts["_digit"].alias("_prefix"), counts["n"]), "radix-digits")
        above = shift
    return at.withColumnRenamed("_prefix", value)


def _last_of_ties(ties: DataFrame, keys: list[str], item: str, small: int) -> DataFrame:
    """keys and ``last``: the need-th ``item`` of each group of ties (keys, item, need), by the order of its UTF-8 bytes.

    Each pass skips the bytes that a group's items have in common and counts
    them by the next two. Where ``small`` or fewer are left they are numbered.
    """
    done = None
    while True:
        ends = ties.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.encode(F.min(item), "UTF-8").alias("_lo"), F.encode(F.max(item), "UTF-8").alias("_hi"))
        differs = "array_position(transform(sequence(1, greatest(length(_lo), length(_hi), 1)), i -> substring(_lo, i, 1) = substring(_hi, i, 1)), false)"
        ends = stored(ends.select(*keys, "_n", F.expr(differs).alias("_at")), "radix-ends")
        held = ties.join(ends, same(ties, ends, keys)).select(*(ties[c] for c in ties.columns), "_n", "_at")
        few = held.where((F.col("_n") <= small) | (F.col("_at") == 0))
        few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(item))).where("_r = need").select(*keys, F.col(item).alias("last"))
        few = stored(few, "radix-last")
        done = few if done is None else done.unionByName(few)
        if ends.where((F.col("_n") > small) & (F.col("_at") > 0)).isEmpty():
            return done
        byte = lambda k: F.coalesce(F.conv(F.hex(F.expr(f"substring(encode({item}, 'UTF-8'), cast(_at as int) + {k}, 1)")), 16, 10).cast("int") + 1, F.lit(0))
        many = held.where((F.col("_n") > small) & (F.col("_at") > 0)).select(*keys, item, "need", (byte(0) * 257 + byte(1)).alias("_digit"))
        counts = many.groupBy(*keys, "need", "_digit").agg(F.count(F.lit(1)).alias("n")).withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("_digit")))
        chosen = stored(counts.where("need > _upto - n and need <= _upto").select(*keys, (F.col("need") - F.col("_upto") + F.col("n")).alias("need"), "_digit"), "radix-bytes")
        ties = stored(many.join(chosen, same(many, chosen, [*keys, "_digit"])).select(*(many[k] for k in keys), many[item], chosen["need"]), "radix-ties")


def top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, small: int = 4096) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``: ``value`` (a long) descending, then ``item``'s UTF-8 bytes ascending.

    Rows with a null value or item have no rank and are left out. Of rows equal
    in value and item that straddle place k, any may come. ``rows`` is read
    once for each digit that differs, so hand in a written table.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(item).isNotNull())
    wanted = stored(rows.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("place")), "radix-places")
    edge = kth(rows, keys, value, wanted).withColumnRenamed(value, "_edge").drop("place")
    tied = edge.where("need < n")
    ties = rows.join(tied, same(rows, tied, keys) & (rows[value] == tied["_edge"])).select(*(rows[c] for c in (*keys, item)), tied["need"])
    last = _last_of_ties(stored(ties, "radix-ties"), keys, item, small)
    ends = edge.join(last, same(edge, last, keys), "left").select(*(edge[c] for c in (*keys, "_edge")), "last")
    kept = rows.join(ends, same(rows, ends, keys)).where((rows[value] > ends["_edge"]) | ((rows[value] == ends["_edge"]) & (ends["last"].isNull() | (rows[item] <= ends["last"]))))
    kept = kept.select(*(rows[c] for c in rows.columns))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))).where(F.col("rank") <= k)
