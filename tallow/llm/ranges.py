"""Parts of even weight along a key: the same parts for the same rows, however the rows are dealt over tasks.

Rows with equal keys are equal rows, a key's copies. Exact sums of weights along the key's order place each copy; its
part is that sum divided by the weight of a part. What the driver holds is bounded by the number of parts, `most_parts`
at most (parts grow beyond that). Copies of one key that lie in several parts, as those of a key with very many rows do,
are named with the number of copies in each, so that no part grows with a key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def id_key(doc_id: str | Column) -> Column:
    """17 characters whose order is that of 64-bit ids, nulls first."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    flipped = F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63))))
    return F.when(c.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(flipped, 16, "0")))


@dataclass
class Parts:
    """first: each part's first key, in order; number: the parts' numbers; pieces: key -> [(part, copies before, copies)]
    of the keys in several parts."""

    first: np.ndarray
    number: np.ndarray
    pieces: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return int(self.number[-1]) + 1 if len(self.number) else 1

    def of(self, keys: list[str]) -> np.ndarray:
        """Places (in first and number) of the parts of keys that are not in pieces."""
        return np.searchsorted(self.first, np.array(keys, "S"), side="right") - 1

    def before(self, part: int) -> int:
        """The part with rows before this one; the last one before the first."""
        return int(self.number[int(np.searchsorted(self.number, part)) - 1])

    def begins(self, key: str) -> int | None:
        """The first part that begins with this key, if one does."""
        at = int(np.searchsorted(self.first, np.bytes_(key), side="left"))
        return int(self.number[at]) if at < len(self.first) and self.first[at] == np.bytes_(key) else None


def even_parts(keys: DataFrame, part_weight: int, most_parts: int = 1 << 16) -> Parts:
    """keys: key (text), weight (of a copy, 1 at least), copies; a row a key."""
    in_order = keys.select("key", F.col("weight").cast("bigint"), F.col("copies").cast("bigint")).repartitionByRange("key")
    ranged = stored(in_order.withColumn("task", F.spark_partition_id()), "ranged")
    mass = F.col("weight") * F.col("copies")
    sums = ranged.groupBy("task").agg(F.sum(mass).alias("mass"))  # a row a task
    total = sums.agg(F.sum("mass")).first()[0] or 0
    size = max(1, part_weight, -(-total // most_parts))
    base = sums.selectExpr("task", "coalesce(sum(mass) over (order by task rows between unbounded preceding and 1 preceding), 0) as base")
    within = "sum(weight * copies) over (partition by task order by key rows unbounded preceding) - weight * copies"
    placed = ranged.join(F.broadcast(base), "task").selectExpr("key", "weight", "copies", f"base + {within} as start")
    placed = placed.selectExpr("*", f"start div {size} as low", f"(start + (copies - 1) * weight) div {size} as high")
    placed = stored(placed, "placed")
    # copy j starts at start + j * weight, so copies from j = ceil((part * size - start) / weight) on lie in the part
    spread = placed.filter("high > low").withColumn("part", F.explode(F.sequence("low", "high")))
    copy = "least(copies, greatest(0, (({0}) * {1} - start + weight - 1) div weight))"
    spread = spread.selectExpr("key", "part", f"{copy.format('part', size)} as skipped", f"{copy.format('part + 1', size)} as reached").filter("reached > skipped")
    firsts = placed.filter("high = low").selectExpr("low as part", "key").unionByName(spread.select("part", "key")).groupBy("part").agg(F.min("key").alias("key"))
    begun = sorted((r["part"], r["key"]) for r in firsts.collect())
    pieces: dict[str, list[tuple[int, int, int]]] = {}
    for r in spread.orderBy("part").collect():
        pieces.setdefault(r["key"], []).append((r["part"], r["skipped"], r["reached"] - r["skipped"]))
    discard(ranged, placed)
    return Parts(np.array([k for _, k in begun], "S"), np.array([p for p, _ in begun], np.int64), pieces)
