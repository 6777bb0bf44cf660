"""Integrity checks: each gives (check_name, severity, item_id) of what violates it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ENTITY_TYPES, EPISODE_SOURCES, INGESTION_SOURCES, RELATION_TYPES, Graph
from .stats import fan_in
from .temporal import overlaps


def _bad(df: DataFrame, name: str, severity: str, id: str = "id") -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.col(id).alias("item_id"))


def _absent(df: DataFrame, column: str, there: DataFrame, key: str = "id") -> DataFrame:
    ids = there.select(F.col(key).alias("_there"))
    return df.filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_there"), "left_anti")


def checks(g: Graph) -> list[DataFrame]:
    ev = g.entity_evidence
    none = g.entities.join(ev.select(F.col("entity_id").alias("id")), "id", "left_anti")
    bare = g.edges.join(g.edge_evidence.select(F.col("edge_id").alias("id")), "id", "left_anti")
    targets = g.entities.select(F.lit("entity").alias("t"), "id").unionByName(g.edges.select(F.lit("edge").alias("t"), "id"))
    emb = g.embeddings.filter("target_type in ('entity', 'edge')")
    emb = emb.join(targets.select("t", F.col("id").alias("_id")), (F.col("target_type") == F.col("t")) & (F.col("target_id") == F.col("_id")), "left_anti")
    word = lambda df, c, words: df.filter(~F.col(c).isin(words))
    return [
        _bad(none, "entity_without_evidence", "error"),
        _bad(bare, "edge_without_evidence", "error"),
        _bad(_absent(g.edges, "superseded_by", g.edges), "edge_superseded_by_dangling", "error"),
        _bad(_absent(g.aliases, "episode_id", g.episodes), "alias_episode_dangling", "warning"),
        _bad(_absent(ev.select("entity_id", "episode_id").distinct(), "episode_id", g.episodes), "evidence_episode_dangling", "error", "episode_id"),
        _bad(emb, "embedding_target_dangling", "warning"),
        _bad(overlaps(g.edges, ["source_id", "target_id", "relation_type", "edge_kind"]), "active_edges_overlap", "warning", "edge_a"),
        _bad(fan_in(g), "episode_fan_in", "error", "superseded_by"),
        _bad(_absent(g.episodes, "superseded_by", g.episodes), "episode_superseded_by_dangling", "error"),
        _bad(word(g.entities, "entity_type", ENTITY_TYPES), "entity_type_unknown", "warning"),
        _bad(word(g.edges, "relation_type", RELATION_TYPES), "relation_type_unknown", "warning"),
        _bad(word(g.episodes, "source_type", EPISODE_SOURCES), "episode_source_unknown", "warning"),
        _bad(word(g.runs, "source_type", INGESTION_SOURCES), "run_source_unknown", "warning"),
    ]


def violations(g: Graph) -> DataFrame:
    return reduce(DataFrame.unionByName, checks(g))


def verdict(g: Graph) -> DataFrame:
    """(check_name, severity, n) of the checks that found something."""
    return violations(g).groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


def valid(g: Graph) -> DataFrame:
    return violations(g).agg((F.count_if(F.col("severity") == "error") == 0).alias("valid"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
