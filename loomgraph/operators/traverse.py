"""Bounded walks over the edges, as rounds of joins with a visited set; each round's frontier is written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, active, at, valid_at
from ..session import Cut, bounded
from .skew import HOT_ROWS, running_count

WALKED = ["likely_owner_of", "co_changes_with"]


def oriented(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(here, there, edge_id, relation_type, confidence): edges as steps that can be taken."""
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), F.col("id").alias("edge_id"), "relation_type", "edge_kind", "confidence")
    back = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), F.col("id").alias("edge_id"), "relation_type", "edge_kind", "confidence")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def reach(g: Graph, seeds: DataFrame, hops: int = 2, valid: str | None = None, relations: list[str] | None = None) -> DataFrame:
    """(id, hops, confidence, seed_score): entities within so many steps of the seeds (id, seed_score), seeds left out.

    An entity keeps its fewest hops, then the best path (greatest least edge confidence), then the best seed. Inactive entities
    are neither reported nor walked through.
    """
    steps = active(g.edges).filter(F.col("relation_type").isin(relations or WALKED))
    if valid is not None:
        steps = steps.filter(valid_at(at(valid)))
    steps = oriented(steps).select("here", "there", F.col("confidence").alias("c"))
    alive = g.entities.filter("status = 'active'").select("id")
    frontier = Cut(seeds.select("id", F.lit(None).cast("double").alias("confidence"), "seed_score"), "frontier").df
    visited, out = frontier.select("id"), None
    for hop in range(1, hops + 1):
        met = frontier.join(steps, F.col("id") == F.col("here")).select(F.col("there").alias("id"), F.least("confidence", "c").alias("confidence"), "seed_score")
        met = met.join(visited, "id", "left_anti").join(alive, "id", "left_semi")
        best = met.groupBy("id").agg(F.max(F.struct("confidence", "seed_score")).alias("b")).select("id", "b.confidence", "b.seed_score")
        frontier = Cut(best, "frontier").df
        visited = visited.union(frontier.select("id"))
        rows = frontier.select("id", F.lit(hop).alias("hops"), "confidence", "seed_score")
        out = rows if out is None else out.unionByName(rows)
        if frontier.isEmpty():
            break
    return out


def neighbours(g: Graph, ids: DataFrame, depth: int = 1, kinds: list[str] | None = None, valid: str | None = None, direction: str = "both") -> DataFrame:
    """(start, id, depth) of everything within depth of each start, whatever its status; the start itself is depth 0."""
    edges = active(g.edges)
    if kinds:
        edges = edges.filter(F.col("edge_kind").isin(kinds))
    if valid is not None:
        edges = edges.filter(valid_at(at(valid)))
    steps = oriented(edges, direction).select("here", "there").distinct()
    seen = Cut(ids.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "near").df
    frontier = seen
    for d in range(1, depth + 1):
        met = frontier.join(steps, F.col("id") == F.col("here")).select("start", F.col("there").alias("id")).distinct()
        frontier = Cut(met.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d)), "near").df
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def shortest_paths(g: Graph, start: DataFrame, goal: DataFrame, most: int = 10, direction: str = "both") -> DataFrame:
    """(start, goal, length, path): a shortest path from each start to each goal, the least in id order among equals; up to `most` steps.

    Steps are counted back from the goals (goal, id, left), once for all starts; paths are then laid from the starts, each step to the
    least id that is one step nearer, so only found paths are ever held. Rows grow with the goals, not with the starts.
    """
    steps_cut = Cut(oriented(active(g.edges), direction).select("here", "there").filter("here is not null and there is not null").distinct(), "steps")
    steps = steps_cut.df
    starts = Cut(start.select(F.col("id").alias("start")).filter("start is not null").distinct(), "starts").df
    near = Cut(goal.select(F.col("id").alias("goal"), "id").filter("id is not null").distinct().withColumn("left", F.lit(0)), "near").df
    goals, rings = near.select("goal"), [near]
    wanted, seen = starts.crossJoin(F.broadcast(goals)), near
    for n in range(1, most + 1):
        if rings[-1].isEmpty() or wanted.join(seen.select("goal", F.col("id").alias("start")), ["goal", "start"], "left_anti").isEmpty():
            break
        # the few of a ring go to the steps, not the steps to them
        met = bounded(rings[-1].select("goal", "id")).join(steps, F.col("id") == F.col("there")).select("goal", F.col("here").alias("id")).distinct()
        rings.append(Cut(met.join(seen.select("goal", "id"), ["goal", "id"], "left_anti").withColumn("left", F.lit(n)), "near").df)
        seen = seen.unionByName(rings[-1])
    at = seen.join(starts, F.col("id") == F.col("start")).select("start", "goal", F.col("left").alias("length"), F.array("start").alias("path"), F.col("id").alias("at"))
    paths = Cut(at, "paths").df
    for n in range(len(rings) - 1, 0, -1):
        # those with n steps left take one; the others have arrived, or begin later
        ring = rings[n - 1].select("goal", F.col("id").alias("there"))
        due = paths.filter(F.col("length") - F.size("path") + 1 == n)
        onward = bounded(due.select("goal", F.col("at").alias("here")).distinct()).join(steps, "here").join(ring, ["goal", "there"]).groupBy("goal", "here").agg(F.min("there").alias("there"))
        moved = due.join(onward.withColumnRenamed("here", "at"), ["goal", "at"]).select("start", "goal", "length", F.concat("path", F.array("there")).alias("path"), F.col("there").alias("at"))
        paths = Cut(paths.filter(F.col("length") - F.size("path") + 1 != n).unionByName(moved), "paths").df
    steps_cut.drop()
    return paths.select("start", "goal", "length", "path")


def top_co_changes(g: Graph, k: int = 5) -> DataFrame:
    """(entity_id, other, weight, rank): the k strongest active co-change partners of each entity, either direction."""
    pairs = active(g.touching).filter("relation_type = 'co_changes_with' and source_id <> target_id")
    other = F.when(F.col("source_id") == F.col("entity_id"), F.col("target_id")).otherwise(F.col("source_id"))
    w = Window.partitionBy("entity_id").orderBy(F.col("weight").desc_nulls_last(), "id")
    return pairs.select("entity_id", other.alias("other"), "weight", "id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k).drop("id")


def owner_links(g: Graph, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(entity_id, edge_id, rank): active owner edges of each entity in either direction, latest start first, open starts last."""
    late = -F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(-(2**62)))
    rows = active(g.touching).filter("relation_type = 'likely_owner_of'").select("entity_id", F.col("id").alias("edge_id"), late.alias("_us"), F.lit(1).alias("_one"))
    return running_count(rows, "entity_id", "_us", "edge_id", "_one", "rank", hot_rows).select("entity_id", "edge_id", "rank")


def nodes_and_edges(g: Graph, valid: str | None = None) -> DataFrame:
    """(item, id, label) of the whole graph for display."""
    e = active(g.edges)
    if valid is not None:
        e = e.filter(valid_at(at(valid)))
    return g.entities.select(F.lit("node").alias("item"), "id", F.col("canonical_name").alias("label")).unionByName(e.select(F.lit("edge").alias("item"), "id", F.col("relation_type").alias("label")))


def cycles(links: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(cycle): the sorted members of each loop in a link table in which a child may have several parents, up to `most` long.

    Records with no way in or no way out are peeled off first, so only what lies between loops is walked.
    """
    left = Cut(links.select(F.col(child).alias("c"), F.col(parent).alias("p")).filter("c is not null and p is not null").distinct(), "links").df
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
        kept = Cut(kept.join(kept.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("c", "p"), "links").df
        now = kept.count()
        left = kept
        if now == n:
            break
        n = now
    walk, found = Cut(left.select(F.col("c").alias("start"), F.col("p").alias("at"), F.array("c").alias("path")), "walk").df, None
    for _ in range(most):
        loop = walk.filter("at = start").select(F.array_join(F.array_sort("path"), ">").alias("cycle")).distinct()
        found = loop if found is None else found.unionByName(loop)
        # a loop is walked from its smallest member only
        walk = Cut(walk.filter("at > start and not array_contains(path, at)").join(left, F.col("at") == F.col("c")).select("start", F.col("p").alias("at"), F.concat("path", F.array("at")).alias("path")), "walk").df
        if walk.isEmpty():
            break
    return found.distinct()
