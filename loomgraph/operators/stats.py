"""Counts, coverage, freshness and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, active, at, days_between


def stats(g: Graph) -> DataFrame:
    """One row: active entities, active edges, active episodes, aliases, invalidated edges. Each count is one row before they meet."""
    n = F.count(F.lit(1))
    e = g.entities.filter("status = 'active'").agg(n.alias("entities"))
    d = g.edges.agg(F.count_if(F.col("invalidated_at").isNull()).alias("edges"), F.count_if(F.col("invalidated_at").isNotNull()).alias("invalidated_edges"))
    p = g.episodes.filter("status = 'active'").agg(n.alias("episodes"))
    return e.crossJoin(d).crossJoin(p).crossJoin(g.aliases.agg(n.alias("aliases")))


def shown_stats(g: Graph) -> DataFrame:
    """One row with all entities, active edges and all episodes."""
    n = F.count(F.lit(1))
    return g.entities.agg(n.alias("entity_count")).crossJoin(active(g.edges).agg(n.alias("edge_count"))).crossJoin(g.episodes.agg(n.alias("episode_count")))


def status_report(g: Graph) -> DataFrame:
    """(section, key, n): entities, edges and episodes by kind and state."""
    n = F.count(F.lit(1)).alias("n")
    part = lambda df, section, key: df.groupBy(key.alias("key")).agg(n).select(F.lit(section).alias("section"), "key", "n")
    state = F.when(F.col("invalidated_at").isNull(), "active").otherwise("invalidated")
    return part(g.entities, "entities", F.col("entity_type")).unionByName(part(g.edges, "edges", state)).unionByName(part(g.episodes, "episodes", F.col("status")))


def dominant_sources(g: Graph) -> DataFrame:
    """(entity_id, source_type): the source most of an entity's evidence comes from, ties by name."""
    ep = g.episodes.select(F.col("id").alias("episode_id"), "source_type")
    counts = g.entity_evidence.select("entity_id", "episode_id").distinct().join(ep, "episode_id").groupBy("entity_id", "source_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n"), "source_type")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("entity_id", "source_type", "n")


def embedding_coverage(g: Graph) -> DataFrame:
    """(target_type, embedded, total, percent) of active entities and episodes; percent is null where there are none."""
    e = g.embeddings.select("target_type", F.col("target_id").alias("id")).distinct()
    targets = g.entities.filter("status = 'active'").select(F.lit("entity").alias("target_type"), "id").unionByName(g.episodes.filter("status = 'active'").select(F.lit("episode").alias("target_type"), "id"))
    joined = targets.join(e.withColumn("has", F.lit(1)), ["target_type", "id"], "left").groupBy("target_type").agg(F.count("has").alias("embedded"), F.count(F.lit(1)).alias("total"))
    return joined.withColumn("percent", F.floor(F.col("embedded") * 100 / F.col("total") + 0.5).cast("int"))


def count_embeddings(g: Graph) -> DataFrame:
    return g.embeddings.agg(F.count_if(F.col("target_type") == "entity").alias("entities"), F.count_if(F.col("target_type") == "episode").alias("episodes"))


def fan_in(g: Graph) -> DataFrame:
    """Episodes that more than one episode names as its successor."""
    return g.episodes.filter("superseded_by is not null").groupBy("superseded_by").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def cursors(g: Graph) -> DataFrame:
    """(source_type, source_scope, cursor): of the latest completed run that has one; numbers stay text."""
    done = g.runs.filter("status = 'completed' and cursor is not null")
    return done.groupBy("source_type", "source_scope").agg(F.max_by("cursor", F.struct("completed_at", "id")).alias("cursor"))


def freshness(g: Graph, warn: int = 7, stale: int = 30) -> DataFrame:
    """(source_type, source_scope, days, state): whole days since the newest completed run; scopes that never completed are unknown."""
    newest = g.runs.groupBy("source_type", "source_scope").agg(F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("done"))
    days = F.floor(days_between(at(g.now), F.col("done"))).cast("long")
    state = F.when(F.col("days").isNull(), "unknown").when(F.col("days") >= stale, "stale").when(F.col("days") >= warn, "warn").otherwise("fresh")
    return newest.withColumn("days", days).withColumn("state", state).select("source_type", "source_scope", "days", "state")


# How bad a state is.
STATE_RANK = {"fresh": 0, "unknown": 1, "warn": 2, "stale": 3}


def overall_freshness(g: Graph) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for p in STATE_RANK.items() for x in p])
    return freshness(g).agg(F.max_by("state", rank[F.col("state")]).alias("state"), F.count(F.lit(1)).alias("n_scopes"))


def run_log(g: Graph) -> DataFrame:
    return g.runs.groupBy("source_type", "status").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("episodes_created").alias("episodes"), F.sum("entities_created").alias("entities"), F.sum("edges_created").alias("edges"))
