"""Best-two-fit packing of items into containers of fixed capacity.

Only the histogram of sizes decides a packing, and it has at most ``capacity`` entries however many
items there are. So the driver packs the histogram (whole families of equal containers at once) and
the items get their containers by rank within their size, computed without a global sort: counts a
partition and size, prefix sums over those counts, then a local running number.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.session import materialize


@dataclass(frozen=True)
class Family:
    """``times`` equal containers, each holding ``sizes`` (descending)."""

    sizes: tuple[int, ...]
    times: int


class _Remaining:
    """Sizes that are left, ascending, with their counts."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def give(self, size: int) -> None:
        if size not in self.count:
            bisect.insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + 1

    def largest_upto(self, limit: int) -> int | None:
        at = bisect.bisect_right(self.sizes, limit)
        return self.sizes[at - 1] if at else None

    def best_two(self, limit: int) -> tuple[int, int] | None:
        """The two items with the largest sum of at most ``limit``."""
        best, low, high = None, 0, bisect.bisect_right(self.sizes, limit) - 1
        while low <= high:
            a, b = self.sizes[low], self.sizes[high]
            if a + b > limit or (low == high and self.count[a] < 2):
                high -= 1
                continue
            if best is None or a + b > sum(best):
                best = (a, b)
                if a + b == limit:
                    break
            low += 1
        return best


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Family]:
    """Families of containers for ``histogram`` (size -> items; sizes from 1 to ``capacity``).

    A container is filled greedily with the largest item that fits; then its smallest item is
    replaced by the two remaining items that fill the gap it leaves best, if those fill it better.
    The finished container is repeated as often as the remaining counts allow, so the number of
    rounds depends on the number of sizes, not of items.
    """
    left, out = _Remaining(histogram), []
    while left.sizes:
        content, room = [], capacity
        while (size := left.largest_upto(room)) is not None:
            content.append(size)
            left.take(size)
            room -= size
        if room and len(content) > 1:
            gap = room + content[-1]
            pair = left.best_two(gap)
            if pair and sum(pair) > content[-1]:
                left.give(content.pop())
                for size in pair:
                    left.take(size)
                content += sorted(pair, reverse=True)
        used: dict[int, int] = {}
        for size in content:
            used[size] = used.get(size, 0) + 1
        more = min(left.count.get(s, 0) // n for s, n in used.items())
        for size, n in used.items():
            if more:
                left.take(size, n * more)
        out.append(Family(tuple(sorted(content, reverse=True)), 1 + more))
    return out


def _slots(families: list[Family], first: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end of ranks, first container, items of the size a container)."""
    out, start, rank = [], first, {}
    for family in families:
        for size in sorted(set(family.sizes)):
            each = family.sizes.count(size)
            begin = rank.get(size, 0)
            rank[size] = begin + each * family.times
            out.append((size, begin, rank[size], start, each))
        start += family.times
    return out


def pack_items(items: DataFrame, id_col: str, size_col: str, capacity: int = 1024) -> DataFrame:
    """(id, piece INT, size INT, container BIGINT), one row a piece.

    An item larger than ``capacity`` is cut into full pieces, each a container of its own, and a
    remainder that is packed like any other item. Items of size 0 or null occupy no room and are
    put into container 0. No item is dropped; repeated rows are packed as often as they occur, and
    equal sizes share containers in no defined order. An empty table gives an empty table.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil(size / capacity) - 1)
    pieces = materialize(
        items.select(F.col(id_col).alias("id"), size.alias("_size"), F.posexplode(F.sequence(F.lit(0), last.cast("int"))).alias("piece", "_"))
        .select("id", "piece", F.least(F.col("_size") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size")),
        "pieces",
    )
    # A partition of the materialized table holds the same rows in the same order each time it is read.
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33))
    counts = numbered.filter("size > 0").groupBy("size", "_part").agg(F.count("*").alias("n"), F.min("_row").alias("_lead"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)
    families = ([Family((capacity,), full)] if full else []) + pack_histogram(histogram, capacity)
    spark = items.sparkSession
    slots = spark.createDataFrame(_slots(families, 1), "size int, begin long, end long, first long, each int")

    from pyspark.sql import Window

    # Ranks: running totals over (size, partition) counts, then over the rows of one size in one partition.
    offsets = counts.withColumn("_offset", F.sum("n").over(Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("size", "_part", F.coalesce("_offset", F.lit(0)).alias("_offset"))
    schema = T.StructType([*numbered.schema.fields, T.StructField("_local", T.LongType())])
    local = numbered.mapInPandas(_running_number, schema)
    ranked = local.join(offsets, ["size", "_part"], "left").withColumn("_rank", F.col("_offset") + F.col("_local"))
    # The table of slots has a few rows a size (sizes are at most the capacity): bounded by the capacity, not the data.
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("size", "_s")), (F.col("size") == F.col("_s")) & (F.col("_rank") >= F.col("begin")) & (F.col("_rank") < F.col("end")), "left")
    container = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("first") + F.floor((F.col("_rank") - F.col("begin")) / F.col("each")))
    return placed.select(F.col("id").alias(id_col), "piece", "size", container.cast("long").alias("container"))


def _running_number(batches):
    """Numbers the rows of each size within one partition, over its batches."""
    import pandas as pd

    seen: dict[tuple[int, int], int] = {}
    for pdf in batches:
        keys = list(zip(pdf["_part"], pdf["size"], strict=True))
        local = pdf.groupby(["_part", "size"], sort=False).cumcount().to_numpy()
        base = pd.Series([seen.get(k, 0) for k in keys], dtype="int64").to_numpy()
        for k, n in pdf.groupby(["_part", "size"], sort=False).size().items():
            seen[k] = seen.get(k, 0) + int(n)
        yield pdf.assign(_local=local + base)
