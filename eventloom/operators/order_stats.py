"""Exact order statistics of groups of any size, by histograms that narrow: values are never ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.operators.sessions import _same
from eventloom.runtime import written

#: A pass splits what is left of a group's range into 2^DIGIT buckets.
DIGIT = 12
#: Parts that a group's rows are dealt to when they meet their rank.
SALTS = 64


def kth(counts: DataFrame, keys: list[str], ranks: DataFrame, value: str = "value", n: str = "n") -> DataFrame:
    """(keys, rank, value): the value at each 0-based ``rank`` of ``ranks`` (keys, rank) among a group's values, in order.

    counts: (keys, value long, n long), a value as often as it likes, n times each; null values aren't counted.
    Keys may be null. Ranks that a group doesn't reach, negative ones and those of unknown groups give no row.

    Each pass counts the values in the bucket that holds the rank by 2^DIGIT smaller ones, and goes on
    with one of them; tasks send one row a bucket, and a group's rows are spread by their value.
    """
    if not keys:
        one = F.lit(0).alias("_one")
        return kth(counts.select(one, value, n), ["_one"], ranks.select(one, "rank"), value, n).drop("_one")
    rows = counts.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(n).alias("_n"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    # each value's place above the least of its group; the widest group says how many passes there are
    ends = written(rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high")), "ends")
    widest = ends.agg(F.max(F.col("_high") - F.col("_low"))).first()[0]
    asked = ranks.select(*keys, F.col("rank").cast("long").alias("rank")).filter("rank >= 0").distinct()
    state = _same(asked, ends.drop("_high"), keys, "inner").withColumn("_left", F.col("rank"))
    passes = 0 if widest is None else max(1, -(-int(widest).bit_length() // DIGIT))
    for level in reversed(range(passes)):
        shift = DIGIT * level
        spread = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = _same(rows, spread, [*keys, "_salt"], "inner").withColumn("_off", F.col("_v") - F.col("_low"))
        if level < passes - 1:
            met = met.filter((F.col("_off") >= 0) & (F.shiftright("_off", shift + DIGIT) == 0))
        held = met.groupBy(*keys, "rank", "_low", "_left", F.shiftright("_off", shift).alias("_b")).agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = held.withColumn("_upto", upto).filter("_upto > _left and _upto - _n <= _left")
        state = written(
            found.select(*keys, "rank", (F.col("_low") + F.shiftleft("_b", shift)).alias("_low"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left")), "ranks"
        )
    return state.select(*keys, "rank", F.col("_low").alias(value))
