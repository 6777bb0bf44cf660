"""The graph: lazily read tables in which each record stands once, and the moment that counts as now."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import load

NOW = "2025-06-01 00:00:00"

# The vocabularies of the data model.
ENTITY_TYPES = "person module service file symbol commit pull_request issue k8s_resource_kind rbac_permission bazel_target document projection".split()
RELATION_TYPES = "authored_by likely_owner_of co_changes_with reviewed_by references contains defined_in imports controller_watches controller_owns rbac_grants build_depends_on authored edited".split()
INGESTION_SOURCES = "git gerrit github source markdown text google_workspace".split()
EPISODE_SOURCES = "git_commit gerrit_change github_pr github_issue manual document source google_doc".split()


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6)


@dataclass
class Graph:
    """All tables are DataFrames without repeated rows; `now` is a parameter of every time-dependent operator, never the clock."""

    spark: SparkSession
    path: str
    now: str = NOW

    def _once(self, name: str) -> DataFrame:
        return load(self.spark, self.path, name).dropDuplicates(["id"])

    @cached_property
    def entities(self) -> DataFrame:
        return self._once("entities")

    @cached_property
    def aliases(self) -> DataFrame:
        return self._once("entity_aliases")

    @cached_property
    def edges(self) -> DataFrame:
        return self._once("edges")

    @cached_property
    def episodes(self) -> DataFrame:
        return self._once("episodes")

    @cached_property
    def entity_evidence(self) -> DataFrame:
        return load(self.spark, self.path, "entity_evidence").dropDuplicates(["entity_id", "episode_id", "extractor"])

    @cached_property
    def runs(self) -> DataFrame:
        return self._once("ingestion_runs")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self._once("stored_embeddings")

    @cached_property
    def edge_evidence(self) -> DataFrame:
        """Edges have no evidence table of their own here: an edge is witnessed by the episodes that witness both its ends."""
        ev = self.entity_evidence.select("entity_id", "episode_id").distinct()
        first = self.edges.select(F.col("id").alias("edge_id"), "source_id", "target_id").join(ev.withColumnRenamed("entity_id", "source_id"), "source_id")
        return first.join(ev.withColumnRenamed("entity_id", "target_id"), ["target_id", "episode_id"]).select("edge_id", "episode_id")

    @cached_property
    def touching(self) -> DataFrame:
        """(entity_id, edge columns): each edge under both its ends, a self-loop once; the OR-join as an equi-join."""
        return self.edges.withColumn("entity_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))


def active(edges: DataFrame) -> DataFrame:
    return edges.filter("invalidated_at is null")


def valid_at(moment: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open validity: from <= t < until, null bounds open."""
    return (F.col(start).isNull() | (F.col(start) <= moment)) & (F.col(end).isNull() | (F.col(end) > moment))


def known_at(moment: Column) -> Column:
    """Learn-time: created at or before, not invalidated by then."""
    return (F.col("created_at") <= moment) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > moment))
