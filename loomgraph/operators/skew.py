"""Joins and orderings that stay spread when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with fewer rows than this is never salted: one task takes them easily.
HOT_ROWS = 200_000
#: At most this many keys are treated as hot, so what the driver sees is bounded; keys beyond it hold less than rows / MAX_HOT each.
MAX_HOT = 1_000
SALTS = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS, max_keys: int = MAX_HOT) -> list:
    """The heaviest values of a column, from a map-side combined count; nulls are left out, as no join matches them."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter(F.col("n") >= hot_rows).orderBy(F.desc("n")).limit(max_keys).collect()]


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", hot: list | None = None, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Equi-join of a possibly skewed left side with a right side that has few rows for each key.

    Rows of hot left keys get a random-looking but fixed salt, and the right rows of just those keys are copied once
    for each salt; every other key is joined as it is. The right key column is dropped. how: inner, left, left_semi or left_anti.
    """
    if hot is None:
        hot = hot_keys(left, left_key, hot_rows)
    if not hot:
        out = left.join(right, left[left_key] == right[right_key], how)
        return out if how in ("left_semi", "left_anti") else out.drop(right[right_key])
    is_hot = F.col(left_key).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    every = F.when(F.col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn("_rsalt", F.explode(every))
    out = salted.join(copied, (salted[left_key] == copied[right_key]) & (salted["_salt"] == copied["_rsalt"]), how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_salt")
    return out.drop(copied[right_key]).drop("_salt", "_rsalt")


def slice_column(df: DataFrame, key: str, order: str, hot: list, slices: int = SALTS) -> DataFrame:
    """Adds _slice: 0 for ordinary keys; for hot ones the number of the quantile range that the row's order value falls into.

    Rows of one key with a smaller order value never have a larger slice. The bounds (len(hot) x slices numbers at most)
    are the only thing that is broadcast.
    """
    if not hot:
        return df.withColumn("_slice", F.lit(0))
    at = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = df.filter(F.col(key).isin(hot)).groupBy(F.col(key).alias("_hk")).agg(F.percentile_approx(order, at, F.lit(2000)).alias("_bounds"))
    joined = df.join(F.broadcast(bounds), df[key] == bounds["_hk"], "left")
    rank: Column = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(F.size(F.expr(f"filter(_bounds, b -> b <= `{order}`)")))
    return joined.withColumn("_slice", rank).drop("_hk", "_bounds")


def running_count(rows: DataFrame, key: str, order: str, tie: str, count: str, out: str, hot_rows: int = HOT_ROWS, slices: int = SALTS) -> DataFrame:
    """Adds the running sum of count within key by (order, tie); a hot key is cut into ranges that are summed apart."""
    hot = hot_keys(rows, key, hot_rows)
    sliced = slice_column(rows, key, order, hot, slices)
    local = F.sum(count).over(Window.partitionBy(key, "_slice").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0))
    if not hot:
        return sliced.withColumn(out, local).drop("_slice")
    sums = sliced.filter(F.col(key).isin(hot)).groupBy(key, "_slice").agg(F.sum(count).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # len(hot) x slices rows at most
    offset = F.broadcast(sums.select(F.col(key).alias("_ok"), F.col("_slice").alias("_os"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    joined = sliced.withColumn("_local", local).join(offset, (F.col(key) == F.col("_ok")) & (F.col("_slice") == F.col("_os")), "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce("_off", F.lit(0))).drop("_local", "_off", "_ok", "_os", "_slice")
