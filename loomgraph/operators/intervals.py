"""Overlapping and gapped validity windows: continuous periods and the stretches between them.

State: for each key an ordered map of disjoint intervals. A window is placed by binary search, swallows the intervals it
touches, and the gaps are what is left between neighbours. Rows of one key reach one state through a hash exchange; a hot
key is cut into quantile ranges of the window start, each with its own state, and a second pass over the far smaller
periods carries the covered end from range to range.

Null start: open past; null end: open future. Windows with end <= start cover nothing. Windows that touch are continuous.
Null key parts form keys of their own. Repeated rows change nothing. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import HOT_ROWS, SALTS, hot_keys, slice_column

PAST, FUTURE = -(2**63), 2**63 - 1


class IntervalMap:
    """Disjoint half-open intervals in order, as two parallel lists."""

    __slots__ = ("ends", "starts")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> None:
        if end <= start:
            return
        starts, ends = self.starts, self.ends
        if not ends or start > ends[-1]:
            starts.append(start)
            ends.append(end)
            return
        first, last = bisect_left(ends, start), bisect_right(starts, end)
        if first < last:
            start, end = min(start, starts[first]), max(end, ends[last - 1])
        starts[first:last] = [start]
        ends[first:last] = [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _states(keys: list[str], gaps_only: bool):
    """Batches sorted by key and slice -> one row a period ('period', and 'part' of a hot key) and a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, state = None, None, IntervalMap()

        def close(rows: list) -> None:
            hot = held[2] >= 0
            if hot or not gaps_only:
                rows.extend((held_key, "part" if hot else "period", s, e) for s, e in state.periods())
            if not hot:
                rows.extend((held_key, "gap", s, e) for s, e in state.gaps())

        def table(rows: list) -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([r[0][-1] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                names=[*keys, "_slice", "kind", "from_us", "until_us"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, sl, s, e = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2", "_slice", "_s", "_e"))
            text = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (sl[1:] != sl[:-1])) + 1
            edges = np.concatenate(([0], new, [len(h1)])).tolist()
            ss, ee, rows = s.tolist(), e.tolist(), []
            last = len(edges) - 2
            for g, (a, b) in enumerate(zip(edges, edges[1:])):
                me = (int(h1[a]), int(h2[a]), int(sl[a]))
                if me != held:
                    if held is not None:
                        close(rows)
                    if gaps_only and b - a == 1 and g < last and me[2] < 0:
                        held = None  # a single window leaves no gap
                        continue
                    held, state = me, IntervalMap()
                    held_key = (*(c[a].as_py() for c in text), me[2])
                add = state.add
                for i in range(a, b):
                    add(ss[i], ee[i])
            if len(rows) > 0:
                yield table(rows)
        if held is not None:
            close(rows := [])
            if rows:
                yield table(rows)

    return run


def coverage(windows: DataFrame, keys: list[str], start_us: str, end_us: str, gaps_only: bool = False, hot_rows: int = HOT_ROWS, slices: int = SALTS) -> DataFrame:
    """(keys..., kind 'period' or 'gap', from_us, until_us); open bounds of periods are null.

    keys: string columns; start_us, end_us: microseconds, null for open.
    """
    rows = (
        windows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.coalesce(F.col(start_us), F.lit(PAST)).alias("_s"), F.coalesce(F.col(end_us), F.lit(FUTURE)).alias("_e"))
        .filter("_e > _s")
        # the null flags keep a null apart from an empty string, which hash alike only by accident
        .withColumn("_h1", F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]))
        .withColumn("_h2", F.xxhash64(F.lit(7), *keys, *[F.col(k).isNull() for k in keys]))
    )
    hot = hot_keys(rows, "_h1", hot_rows)
    rows = slice_column(rows, "_h1", "_s", hot, slices)
    if hot:
        rows = rows.withColumn("_slice", F.when(F.col("_h1").isin(hot), F.col("_slice")).otherwise(F.lit(-1)))
    else:
        rows = rows.withColumn("_slice", F.lit(-1))
    schema = ", ".join(f"`{k}` string" for k in keys) + ", _slice int, kind string, from_us long, until_us long"
    by = ["_h1", "_h2", "_slice"]
    found = rows.repartition(*by).sortWithinPartitions(*by, "_s").mapInArrow(_states(keys, gaps_only), schema)
    if hot:
        final = found.filter("kind <> 'part'")
        found = final.unionByName(_carried(found.filter("kind = 'part'"), keys, gaps_only))
    opened = lambda c, edge: F.when(F.col(c) != edge, F.col(c)).alias(c)
    return found.select(*keys, "kind", opened("from_us", PAST), opened("until_us", FUTURE))


def _carried(parts: DataFrame, keys: list[str], gaps_only: bool) -> DataFrame:
    """Joins the ranges of hot keys: the covered end so far comes in from the ranges before, a few rows for each key."""
    ends = parts.groupBy(*keys, "_slice").agg(F.max("until_us").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_cs"), F.max("_end").over(before).alias("_carry"))
    match = F.col("_cs") == F.col("_slice")
    for i, k in enumerate(keys):
        match = match & F.col(f"_c{i}").eqNullSafe(F.col(k))
    joined = parts.join(carry, match).filter("_carry is null or until_us > _carry").select(*parts.columns, "_carry")
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("from_us")
    # within a range the periods are disjoint already, so the covered end before each is its neighbour's or the carry
    seen = joined.withColumn("_prev", F.greatest(F.lag("until_us").over(in_slice), F.col("_carry")))
    gaps = seen.filter("from_us > _prev").select(*keys, "_slice", F.lit("gap").alias("kind"), F.col("_prev").alias("from_us"), F.col("from_us").alias("until_us"))
    if gaps_only:
        return gaps
    # a period runs from a start that nothing covers to the greatest end before the next such start
    heads = seen.withColumn("_head", (F.col("_prev").isNull() | (F.col("from_us") > F.col("_prev"))).cast("int"))
    sums = heads.groupBy(*keys, "_slice").agg(F.sum("_head").alias("_n"))
    offset = sums.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_cs"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = heads.join(offset, match).withColumn("_no", F.col("_off") + F.sum("_head").over(in_slice))
    periods = numbered.groupBy(*keys, "_no").agg(F.min("from_us").alias("from_us"), F.max("until_us").alias("until_us"))
    return gaps.unionByName(periods.select(*keys, F.lit(-1).alias("_slice"), F.lit("period").alias("kind"), "from_us", "until_us"))
