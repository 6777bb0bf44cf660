"""What in the graph is going bad: stale, contradicted, concentrated, dormant and orphaned items, and the risk owners leave behind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, active, at, days_between, valid_at

STALE_DAYS, DORMANT_DAYS, RISK_EDGES, HALF_LIFE = 180, 90, 3, 90
# Severities, worst first.
SEVERITIES = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def _severity(age, stale_days: int):
    return F.when(age > 8 * stale_days, "critical").when(age > 4 * stale_days, "high").when(age > 2 * stale_days, "medium").when(age > stale_days, "low")


def live_evidence(g: Graph) -> DataFrame:
    """(entity_id, episode_id, timestamp, actor, owner_id) of evidence episodes that are not redacted."""
    ep = g.episodes.filter("status <> 'redacted'").select(F.col("id").alias("episode_id"), "timestamp", "actor", "owner_id")
    return g.entity_evidence.select("entity_id", "episode_id").distinct().join(ep, "episode_id")


def stale(g: Graph, stale_days: int = STALE_DAYS) -> DataFrame:
    """(category, item_type, item_id, severity): active entities whose newest evidence is old."""
    last = live_evidence(g).groupBy("entity_id").agg(F.max("timestamp").alias("last"))
    rows = g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id")).join(last, "entity_id")
    age = days_between(at(g.now), F.col("last"))
    return _items(rows.select("entity_id", _severity(age, stale_days).alias("severity")), "stale_evidence", "entity")


def stale_edges(g: Graph, stale_days: int = STALE_DAYS) -> DataFrame:
    ep = g.episodes.filter("status <> 'redacted'").select(F.col("id").alias("episode_id"), "timestamp")
    last = g.edge_evidence.join(ep, "episode_id").groupBy("edge_id").agg(F.max("timestamp").alias("last"))
    rows = active(g.edges).select(F.col("id").alias("edge_id")).join(last, "edge_id")
    return _items(rows.select(F.col("edge_id").alias("entity_id"), _severity(days_between(at(g.now), F.col("last")), stale_days).alias("severity")), "stale_evidence", "edge")


def contradicted(g: Graph, stale_days: int = STALE_DAYS) -> DataFrame:
    """Edges superseded and invalidated within twice the stale days; medium in the later half."""
    age = days_between(at(g.now), F.col("invalidated_at"))
    rows = g.edges.filter("trim(superseded_by) <> '' and invalidated_at is not null").withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") <= 2 * stale_days))
    return _items(rows.select(F.col("id").alias("entity_id"), F.when(F.col("age") <= stale_days, "medium").otherwise("low").alias("severity")), "contradicted", "edge")


def concentrated(g: Graph, least_edges: int = RISK_EDGES, most_owners: int = 2) -> DataFrame:
    """Entities with many active edges and few people behind them; the two counts are made apart and joined, not multiplied."""
    edges = active(g.touching).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_edges")).filter(F.col("n_edges") >= least_edges)
    who = F.coalesce(F.expr("nullif(owner_id, '')"), F.expr("nullif(actor, '')"))
    owners = live_evidence(g).groupBy("entity_id").agg(F.countDistinct(who).alias("n_owners")).filter((F.col("n_owners") >= 1) & (F.col("n_owners") <= most_owners))
    rows = edges.join(owners, "entity_id").join(g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return _items(rows.select("entity_id", F.when(F.col("n_owners") == 1, "high").otherwise("medium").alias("severity")), "concentrated_risk", "entity")


def actor_weights(g: Graph) -> DataFrame:
    """(entity_id, actor, weight, last): evidence halves in weight every HALF_LIFE days; each day's share is rounded, so sums are the same in any order."""
    age = F.greatest(F.lit(0.0), days_between(at(g.now), F.col("timestamp")))
    w = F.round(F.exp(-age * math.log(2) / HALF_LIFE), 9)
    return live_evidence(g).filter("actor is not null and actor <> ''").groupBy("entity_id", "actor").agg(F.sum(w).alias("weight"), F.max("timestamp").alias("last"))


def top_actor(g: Graph) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.round("weight", 6).desc(), "actor")
    return actor_weights(g).withColumn("r", F.row_number().over(w)).filter("r = 1").select("entity_id", "actor", F.round("weight", 6).alias("weight"), "last")


def dormant(g: Graph, dormant_days: int = DORMANT_DAYS) -> DataFrame:
    """Active entities whose heaviest actor has been silent on them for long."""
    age = days_between(at(g.now), F.col("last"))
    rows = top_actor(g).join(g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").withColumn("age", age).filter(F.col("age") > dormant_days)
    return _items(rows.select("entity_id", F.when(F.col("age") > 2 * dormant_days, "high").otherwise("medium").alias("severity")), "dormant_owner", "entity")


def orphaned(g: Graph) -> DataFrame:
    used = active(g.touching).select("entity_id").distinct()
    rows = g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id")).join(used, "entity_id", "left_anti")
    return _items(rows.withColumn("severity", F.lit("low")), "orphaned", "entity")


def _items(rows: DataFrame, category: str, kind: str) -> DataFrame:
    return rows.filter("severity is not null").select(F.lit(category).alias("category"), F.lit(kind).alias("item_type"), F.col("entity_id").alias("item_id"), "severity")


def report(g: Graph) -> DataFrame:
    out = stale(g)
    for part in (stale_edges, contradicted, concentrated, dormant, orphaned):
        out = out.unionByName(part(g))
    return out


def summary(g: Graph) -> DataFrame:
    return report(g).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def overlay(g: Graph) -> DataFrame:
    """(entity_id, category, severity): the worst item of each entity, contradictions left out, ties by category."""
    rank = F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p])
    rows = report(g).filter("item_type = 'entity' and category <> 'contradicted'")
    best = rows.groupBy(F.col("item_id").alias("entity_id")).agg(F.min(F.struct(rank[F.col("severity")].alias("k"), "category", "severity")).alias("m"))
    return best.select("entity_id", "m.category", "m.severity")


def strongest_owner(g: Graph, valid: str | None = None) -> DataFrame:
    """(entity_id, owner, confidence): the most confident active owner edge valid then, ties by id."""
    e = active(g.edges).filter("relation_type = 'likely_owner_of'")
    e = e.filter(valid_at(at(valid or g.now)))
    w = Window.partitionBy("target_id").orderBy(F.desc("confidence"), "id")
    return e.withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("target_id").alias("entity_id"), F.col("source_id").alias("owner"), "confidence")


def coupling(g: Graph) -> DataFrame:
    """(entity_id, n): active co-change edges that touch an entity."""
    return active(g.touching).filter("relation_type = 'co_changes_with'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("coupling"))


def owner_activity(g: Graph) -> DataFrame:
    """(owner, last): start of the newest authored_by edge of a person, else the newest evidence of that person."""
    authored = active(g.edges).filter("relation_type = 'authored_by'").groupBy(F.col("target_id").alias("owner")).agg(F.max("valid_from").alias("authored"))
    seen = live_evidence(g).groupBy(F.col("entity_id").alias("owner")).agg(F.max("timestamp").alias("seen"))
    return authored.join(seen, "owner", "full_outer").select("owner", F.coalesce("authored", "seen").alias("last"))


def ownership(g: Graph, module: str | None = None, least_confidence: float = 0.1, limit: int | None = 20, dormant_after: int = 180, coupled: int = 10) -> DataFrame:
    """The owned entities by risk: (entity_id, canonical_name, owner, confidence, days_silent, coupling, risk)."""
    own = strongest_owner(g).filter(F.col("confidence") >= least_confidence)
    e = g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id"), "canonical_name")
    if module is not None:
        e = e.filter(F.col("canonical_name").startswith(module))
    risky = concentrated(g).select(F.col("item_id").alias("entity_id"), F.lit(True).alias("concentrated"))
    has = g.entity_evidence.select("entity_id").distinct()
    rows = e.join(own, "entity_id").join(has, "entity_id", "left_semi").join(owner_activity(g), "owner", "left").join(coupling(g), "entity_id", "left").join(risky, "entity_id", "left")
    rows = rows.withColumn("days_silent", F.floor(days_between(at(g.now), F.col("last"))).cast("long")).withColumn("coupling", F.coalesce("coupling", F.lit(0)))
    quiet = F.coalesce(F.col("days_silent") > dormant_after, F.lit(False))
    tight = F.coalesce("concentrated", F.lit(False)) | (F.col("coupling") >= coupled)
    rows = rows.withColumn("risk", F.when(quiet & tight, "critical").when(quiet | tight, "elevated").otherwise("stable"))
    rows = rows.select("entity_id", "canonical_name", "owner", "confidence", "days_silent", "coupling", "risk")
    if limit is None:
        return rows
    rank = F.when(F.col("risk") == "critical", 0).when(F.col("risk") == "elevated", 1).otherwise(2)
    return rows.orderBy(rank, F.desc("coupling"), F.col("days_silent").desc_nulls_last(), "entity_id").limit(limit)
