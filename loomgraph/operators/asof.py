"""Attributes as known at event time: numbered versions instead of range joins.

Each entity's changes split its time into versions. A change's number and each event's number come from a running count of
changes over narrow (entity, time) rows, so that the wide attributes meet their events in an equi-join on entity and number.
Where facts overlap, one holds for a range of versions; the range is laid out on the O(log) nodes of a binary tree over version numbers, each node
keeps its best fact, and a version takes the best of the nodes above it. No row set is quadratic, no group is collected.

A fact is known from its start (included) to its end (excluded; null: never ends); facts that end before or when they start
are never known. Of several known ones the latest start wins, then the greatest id. Null entities or times match nothing. Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut
from .skew import HOT_ROWS, running_count, salted_join


def as_known(events: DataFrame, facts: DataFrame, entity: str, event_time: str, fact_entity: str, fact_id: str, known_from: str, known_until: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The events (all columns, entity and time not null) that have a known fact, with _fact: that fact's id."""
    f = facts.select(F.col(fact_entity).alias("_e"), F.col(fact_id).alias("_id"), F.col(known_from).alias("_a"), F.col(known_until).alias("_b"))
    f = Cut(f.filter("_e is not null and _id is not null and _a is not null and (_b is null or _b > _a)").distinct(), "facts").df
    ev = events.filter(F.col(entity).isNotNull() & F.col(event_time).isNotNull())
    # narrow rows: changes first (kind 0), so that an event at the very time of a change sees it
    change = f.select("_e", F.explode(F.array("_a", "_b")).alias("_t")).filter("_t is not null").distinct()
    seen = ev.select(F.col(entity).alias("_e"), F.col(event_time).alias("_t")).distinct()
    seen = seen.join(f.select("_e").distinct(), "_e", "left_semi")
    narrow = change.select("_e", "_t", F.lit(0).alias("_kind"), F.lit(1).alias("_n")).unionByName(seen.select("_e", "_t", F.lit(1).alias("_kind"), F.lit(0).alias("_n")))
    numbered = Cut(running_count(narrow.withColumn("_us", F.unix_micros(F.col("_t").cast("timestamp"))), "_e", "_us", "_kind", "_n", "_v", hot_rows).select("_e", "_t", "_kind", "_v"), "versions").df
    change_no = numbered.filter("_kind = 0").select(F.col("_e").alias("_ce"), F.col("_t").alias("_ct"), "_v")
    first = f.join(change_no.withColumnRenamed("_v", "_va"), (F.col("_e") == F.col("_ce")) & (F.col("_a") == F.col("_ct"))).drop("_ce", "_ct")
    last = numbered.groupBy("_e").agg(F.max("_v").alias("_vmax"))
    spans = first.join(change_no.withColumnRenamed("_v", "_vb"), (F.col("_e") == F.col("_ce")) & (F.col("_b") == F.col("_ct")), "left").drop("_ce", "_ct").join(last, "_e")
    # versions [lo, hi) -> tree nodes: at each level the odd left end and the even-bounded right end
    spans = spans.withColumn("_lo", F.col("_va")).withColumn("_hi", F.coalesce("_vb", F.col("_vmax") + 1))
    nodes = F.expr(
        """filter(flatten(transform(sequence(0, cast(floor(log2(_hi - _lo)) as int) + 1), l -> array(
             named_struct('l', l, 'k', if(shiftright(_lo + shiftleft(1L, l) - 1, l) < shiftright(_hi, l) and shiftright(_lo + shiftleft(1L, l) - 1, l) % 2 = 1, shiftright(_lo + shiftleft(1L, l) - 1, l), null)),
             named_struct('l', l, 'k', if(shiftright(_lo + shiftleft(1L, l) - 1, l) < shiftright(_hi, l) and shiftright(_hi, l) % 2 = 1, shiftright(_hi, l) - 1, null))))), x -> x.k is not null)"""
    )
    best = spans.select("_e", F.explode(nodes).alias("_x"), F.struct(F.col("_a").alias("a"), F.col("_id").alias("id")).alias("_w")).groupBy("_e", F.col("_x.l").alias("_l"), F.col("_x.k").alias("_k")).agg(F.max("_w").alias("_w"))
    levels = best.groupBy("_e").agg(F.max("_l").alias("_lmax"))
    # only versions that an event falls into are looked up
    asked = numbered.filter("_kind = 1").select("_e", "_v").distinct().join(levels, "_e")
    asked = asked.select("_e", "_v", F.explode(F.expr("transform(sequence(0, _lmax), l -> named_struct('l', l, 'k', shiftright(_v, l)))")).alias("_x"))
    node = lambda l, k: F.concat_ws("|", "_e", l, k)
    tops = best.select(node("_l", "_k").alias("_bn"), "_w")
    met = salted_join(asked.select("_e", "_v", node("_x.l", "_x.k").alias("_n")), tops, "_n", "_bn", "inner", hot_rows=hot_rows)
    winner = met.groupBy("_e", "_v").agg(F.max("_w").alias("_w"))
    # back to the events: (entity, time) -> number -> fact, the wide rows moving once
    at = numbered.filter("_kind = 1").join(winner, ["_e", "_v"]).select(F.struct("_e", "_t").alias("_at"), F.col("_w.id").alias("_fact"))
    keyed = ev.withColumn("_ek", F.struct(F.col(entity).alias("_e"), F.col(event_time).alias("_t")))
    return keyed.join(at, keyed["_ek"] == at["_at"]).drop("_ek", "_at")
