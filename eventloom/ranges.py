"""Range buckets by quantiles, for tables that are dealt out and laid in order."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

#: Ranges at most: one number each goes to the driver and into the plan.
MOST_RANGES = 20_000


def bounds(rows: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending lower bounds of the ranges after the first; fewer than ``parts``."""
    parts = min(parts, MOST_RANGES)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx(column, shares, 20 * parts)).first()[0] or []))


def even_bounds(rows: DataFrame, column: str, weight: str, parts: int, fineness: int = 8) -> list[int]:
    """As ``bounds``, for ranges of about even sums of ``weight``: finer ranges are added up and put together."""
    parts = min(parts, MOST_RANGES)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first() if parts > 1 else (0, 0)
    if not n:
        return []
    # a row counts once and once more for every mean weight in it, up to a whole range's worth
    times = 1 + F.least(F.expr(f"coalesce({weight}, 0)") * n / max(1, total), F.lit(1 + n // parts)).cast("int")
    fine = bounds(rows.select(F.explode(F.array_repeat(column, times)).alias(column)), column, min(parts * fineness, MOST_RANGES))
    sums = rows.groupBy(bucket(F.col(column), fine).alias("_b")).agg(F.sum(weight).alias("_w")).collect()
    held = dict.fromkeys(range(len(fine) + 1), 0) | {r["_b"]: r["_w"] or 0 for r in sums}
    total, before, lower, now = max(1, total), 0, [], 0
    for b in range(len(fine) + 1):
        part = min(parts - 1, (2 * before + held[b]) * parts // (2 * total))  # where the middle of it lies
        if b and part > now:
            lower.append(fine[b - 1])
        now, before = max(now, part), before + held[b]
    return lower


def bucket(column: Column, lower: list[int]) -> Column:
    """Number of bounds that are not above the column, found in two steps of about sqrt(n); null: 0."""
    if not lower:
        return F.lit(0)
    step = max(1, isqrt(len(lower)))
    groups = [lower[i : i + step] for i in range(0, len(lower), step)]
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    heads = literal([g[0] for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b <= column))
    fine = F.size(F.filter(F.element_at(F.array(*map(literal, groups)), coarse), lambda b: b <= column))
    return F.when(column.isNull() | (coarse < 1), 0).otherwise((coarse - 1) * step + fine).cast("int")


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """Each bucket 0..n-1 of the column ``bucket`` in a partition of its own."""
    return rows.repartitionById(n, F.col("bucket").cast("int"))
