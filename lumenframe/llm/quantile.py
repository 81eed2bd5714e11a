"""Exact splits of integer keys by weight, found with repeated bounded histograms.

Each round is one pass with a map-side combined aggregate; the driver sees at most
``buckets`` rows for each open search, however large the table is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Search:
    """The key that parts a group: weight below it is as near to ``target`` as its keys allow."""

    low: int
    high: int  # exclusive
    target: float
    below: float = 0.0  # weight of keys under low
    done: bool = False
    cut: int = 0


def literal_lookup(values: list, at: Column, kind: str) -> Column:
    """values[at] for a list whose length is bounded by the number of groups."""
    return F.get(F.lit([0] if not values else list(values)).cast(f"array<{kind}>"), at)


def search(df: DataFrame, group: Column, key: Column, weight: Column, searches: dict[int, Search], buckets: int = 1024, slack: float = 0.0, up: bool = False) -> dict[int, Search]:
    """Find the cut of every group in searches (its groups are small integers from 0).

    A search ends when its bucket holds one key value or at most ``slack`` of weight. With ``up``, the cut
    is never below the target.
    """
    size = max(searches) + 1
    work = df.select(group.cast("int").alias("g"), key.cast("long").alias("k"), weight.cast("double").alias("w"))
    while open_ := {g: s for g, s in searches.items() if not s.done}:
        low, high, width = [0] * size, [0] * size, [1] * size
        for g, s in open_.items():
            low[g], high[g], width[g] = s.low, s.high, max(1, -(-(s.high - s.low) // buckets))
        at = F.col("g")
        rows = (
            work.withColumns({"lo": literal_lookup(low, at, "long"), "hi": literal_lookup(high, at, "long"), "wd": literal_lookup(width, at, "long")})
            .where("k >= lo AND k < hi")
            .groupBy("g", F.expr("(k - lo) div wd").alias("b"))
            .agg(F.sum("w").alias("w"))
            .collect()
        )
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r.g, []).append((r.b, r.w))
        for g, s in open_.items():
            sums, below = sorted(found.get(g, [])), s.below
            for b, w in sums:
                if below + w >= s.target or (b, w) == sums[-1]:
                    start, end = s.low + b * width[g], min(s.high, s.low + (b + 1) * width[g])
                    if width[g] == 1 or w <= slack:
                        s.done, s.cut = True, (end if up or below + w - s.target <= s.target - below else start)
                    else:
                        s.low, s.high, s.below = start, end, below
                    break
                below += w
            else:
                s.done, s.cut = True, s.low
    return searches
