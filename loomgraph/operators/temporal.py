"""Snapshots, histories, graph differences, overlaps and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, active, at, known_at, valid_at
from .skew import HOT_ROWS, running_count


def find_edges(g: Graph, source: str | None = None, target: str | None = None, relation: str | None = None, kind: str | None = None, valid: str | None = None, as_of: str | None = None, include_invalidated: bool = False) -> DataFrame:
    """Edges under all given conditions; without as_of and include_invalidated only active ones. Validity and learn time compose."""
    e = g.edges
    for column, value in (("source_id", source), ("target_id", target), ("relation_type", relation), ("edge_kind", kind)):
        if value is not None:
            e = e.filter(F.col(column) == value)
    if as_of is not None:
        e = e.filter(known_at(at(as_of)))
    elif not include_invalidated:
        e = active(e)
    return e.filter(valid_at(at(valid))) if valid is not None else e


def snapshot(g: Graph, moment: str) -> DataFrame:
    """(item, id): active entities and active edges valid at the moment."""
    nodes = g.entities.filter("status = 'active'").select(F.lit("entity").alias("item"), "id")
    return nodes.unionByName(active(g.edges).filter(valid_at(at(moment))).select(F.lit("edge").alias("item"), "id"))


def fact_history(g: Graph, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All edges with their place in the history of their pair: open past first, then by start and creation.

    The place is a running count, so the history of one overlong pair is counted in several tasks.
    """
    start = F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(-(2**62)))
    rows = g.edges.select("source_id", "target_id", "id", "relation_type", F.concat_ws("|", "source_id", "target_id").alias("_pair"), start.alias("_us"), F.struct("created_at", "id").alias("_tie"), F.lit(1).alias("_one"))
    return running_count(rows, "_pair", "_us", "_tie", "_one", "position", hot_rows).select("source_id", "target_id", "id", "relation_type", "position")


def entity_history(g: Graph, name: str) -> DataFrame:
    """Outgoing and incoming edges of the named entities, invalidated ones too."""
    who = g.entities.filter(F.col("canonical_name") == name).select(F.col("id").alias("entity_id"))
    return g.touching.join(who, "entity_id").select("entity_id", F.col("id").alias("edge_id"), F.when(F.col("source_id") == F.col("entity_id"), "out").otherwise("in").alias("direction"), "relation_type", "created_at")


def diff(g: Graph, a: str, b: str, transient: bool = True) -> DataFrame:
    """(edge_id, bucket): unchanged, superseded, invalidated, added, transient between two moments; invalidation plays no role here."""
    in_a, in_b = valid_at(at(a)), valid_at(at(b))
    gone = F.when((F.trim("superseded_by") != ""), "superseded").otherwise("invalidated")
    bucket = F.when(in_a & in_b, "unchanged").when(in_a, gone).when(in_b, "added")
    if transient:
        bucket = bucket.when((F.col("valid_from") > at(a)) & (F.col("valid_until") <= at(b)), "transient")
    # both snapshots come from one scan: membership is a flag, so the full outer join by id falls away
    return g.edges.select(F.col("id").alias("edge_id"), bucket.alias("bucket")).filter("bucket is not null")


def dominant_owner(g: Graph, moment: str) -> DataFrame:
    """(entity_id, owner): the owner edge valid then of greatest weight, then confidence, then id."""
    w = Window.partitionBy("target_id").orderBy(F.col("weight").desc_nulls_last(), F.desc("confidence"), F.desc("id"))
    owners = g.edges.filter("relation_type = 'likely_owner_of'").filter(valid_at(at(moment)))
    return owners.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("owner"))


def ownership_shifts(g: Graph, a: str, b: str) -> DataFrame:
    """(entity_id, owner_before, owner_after) where the dominant owner differs, none counting as a value."""
    before = dominant_owner(g, a).withColumnRenamed("owner", "owner_before")
    after = dominant_owner(g, b).withColumnRenamed("owner", "owner_after")
    return before.join(after, "entity_id", "full_outer").filter(~F.col("owner_before").eqNullSafe(F.col("owner_after")))


def overlaps(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(edge_a < edge_b): active edges of equal keys whose windows overlap; touching windows do not.

    The equi-join on the keys leaves the range condition as a residual. Windows are laid out by a running maximum first, so
    edges that overlap nothing before or after them never enter the join.
    """
    null_low, null_high = F.lit(-(2**62)), F.lit(2**62)
    s = F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), null_low)
    e = F.coalesce(F.unix_micros(F.col("valid_until").cast("timestamp")), null_high)
    rows = active(edges).select(*keys, "id", s.alias("s"), e.alias("e"))
    before = Window.partitionBy(*keys).orderBy("s", "e", "id")
    flagged = rows.withColumn("reach", F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.lead("s").over(before))
    # windows that are empty or run backwards can still be said to overlap; they are kept whatever their neighbours
    some = flagged.filter("reach > s or next < e or e <= s").select(*keys, "id", "s", "e")
    left = some.select(*keys, F.col("id").alias("edge_a"), F.col("s").alias("sa"), F.col("e").alias("ea"))
    right = some.select(*keys, F.col("id").alias("edge_b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    return left.join(right, keys).filter("edge_a < edge_b and sa < eb and sb < ea").select("edge_a", "edge_b", *keys)


def conflicts(g: Graph, proposed: DataFrame) -> DataFrame:
    """For proposed edges (key columns and window as in edges): the first active edge each would overlap, by id."""
    keys = ["source_id", "target_id", "relation_type", "edge_kind"]
    p = proposed.select(F.col("id").alias("proposed_id"), *keys, F.col("valid_from").alias("pf"), F.col("valid_until").alias("pu"))
    hit = active(g.edges).join(p, keys).filter("id <> proposed_id and not ((pf is not null and valid_until is not null and valid_until <= pf) or (pu is not null and valid_from is not null and pu <= valid_from))")
    return hit.groupBy("proposed_id").agg(F.min("id").alias("conflict_id"))


def supersede(g: Graph, new: DataFrame) -> DataFrame:
    """The edge table after each new edge (with `replaces`, the id of an old one) closed its predecessor.

    The old row ends where the new one starts (now, if open), is invalidated now and points to the new row. A replacement of a
    missing or already closed edge has no effect. Of several for one edge the one with the smallest id takes effect.
    """
    first = new.groupBy("replaces").agg(F.min(F.struct("id", "valid_from")).alias("n")).select("replaces", F.col("n.id").alias("by"), F.col("n.valid_from").alias("start"))
    now = at(g.now)
    joined = g.edges.join(first, g.edges["id"] == first["replaces"], "left")
    hit = F.col("by").isNotNull() & F.col("invalidated_at").isNull()
    closed = {
        "valid_until": F.when(hit, F.coalesce("start", now)).otherwise(F.col("valid_until")),
        "invalidated_at": F.when(hit, now).otherwise(F.col("invalidated_at")),
        "superseded_by": F.when(hit, F.col("by")).otherwise(F.col("superseded_by")),
    }
    old = joined.withColumns(closed).select(*g.edges.columns)
    open_ = active(g.edges).select(F.col("id").alias("replaces"))
    effective = new.join(first.select(F.col("by").alias("id"), "replaces"), ["id", "replaces"], "left_semi").join(open_, "replaces", "left_semi")
    return old.unionByName(effective.select(*g.edges.columns))


def series(g: Graph, step_days: int = 30) -> DataFrame:
    """(day, n_edges): how many active edges are valid at each step between the bounds, from starts and ends instead of a range join."""
    e = active(g.edges)
    day = lambda c: F.to_date(c)
    bounds = e.agg(day(F.min("valid_from")).alias("lo"), F.greatest(day(F.max("valid_until")), day(F.max("valid_from"))).alias("hi"))
    days = bounds.select(F.explode(F.expr(f"sequence(lo, hi, interval {step_days} days)")).alias("day"))
    # an edge counts at a step t if from <= t < until: +1 from the first step at or after its start, -1 from the first at or after its end
    lo = bounds.select("lo")
    index = lambda c: F.greatest(F.lit(0), F.ceil((F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / (86400e6 * step_days)))
    sound = e.filter("valid_from is null or valid_until is null or valid_until > valid_from").crossJoin(F.broadcast(lo))
    ups = sound.select(F.coalesce(index("valid_from"), F.lit(0)).alias("i"), F.lit(1).alias("d"))
    downs = sound.filter("valid_until is not null").select(index("valid_until").alias("i"), F.lit(-1).alias("d"))
    changes = ups.unionByName(downs).groupBy("i").agg(F.sum("d").alias("d"))
    steps = days.select("day", (F.datediff("day", F.lit("1970-01-01")) - F.datediff(F.min("day").over(Window.partitionBy()), F.lit("1970-01-01"))).alias("off")).select("day", (F.col("off") / step_days).cast("long").alias("i"))
    # the grid has one row a step, however many edges there are
    total = steps.join(changes, "i", "left").withColumn("n_edges", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return total.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("n_edges").cast("long"))


def temporal_bounds(g: Graph) -> DataFrame:
    return active(g.edges).agg(F.min("valid_from").alias("min_valid_from"), F.max("valid_until").alias("max_valid_until"))


def open_window(start: Column, end: Column) -> Column:
    return end.isNull() | start.isNull() | (end > start)
