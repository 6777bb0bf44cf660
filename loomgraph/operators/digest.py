"""Budgeted context packs and digests, put together from the other operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, snippet, topic_terms
from ..graph import Graph, active, at, days_between
from . import search
from .crossref import primary_entities
from .decay import actor_weights, live_evidence, strongest_owner
from .traverse import top_co_changes


def within_budget(rows: DataFrame, budget: int, group: list[str], order: list) -> DataFrame:
    """Adds used, and keeps the rows up to the first that would overflow the budget of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)


def greedy(rows: DataFrame, budget: int, group: str, order: list[str]) -> DataFrame:
    """As within_budget, but a row that does not fit is skipped and later, smaller ones may still come in; for candidate lists, which are short."""
    schema = rows.schema

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for i, t in zip(pdf.sort_values(order).index, pdf.sort_values(order)["tokens"]):
            if t <= left:
                keep.append(i)
                left -= t
        return pdf.loc[keep]

    return rows.groupBy(group).applyInPandas(take, schema)


# How many characters of an episode a pack shows.
EXCERPT = {"github_pr": 1200, "github_issue": 1000, "git_commit": 600}


def context(g: Graph, question: str, budget: int = 8000, as_of: str | None = None, most_entities: int = 30, most_edges: int = 20, most_discussions: int = 20) -> DataFrame:
    """(section, id, tokens, used): entities, edges and discussions on a question; 65 % of the budget goes to the graph, 35 % to discussions."""
    terms = " ".join(topic_terms(question))
    e = search.search_entities(g, terms, any_term=True).orderBy("rank", "id").limit(most_entities).join(g.entities.select("id", search.entity_text().alias("body")), "id")
    d = search.search_edges(g, terms, as_of=as_of, any_term=True).orderBy("rank", "id").limit(most_edges).join(g.edges.select("id", F.col("fact").alias("body")), "id")
    limit = F.when(F.col("source_type") == "github_pr", 1200).when(F.col("source_type") == "github_issue", 1000).when(F.col("source_type") == "git_commit", 600).otherwise(800)
    p = search.discussions(g, terms, most_discussions).join(g.episodes.select("id", F.trim("content").alias("content")), "id").withColumn("body", F.substring("content", F.lit(1), limit))
    part = lambda df, section, k: df.select(F.lit(section).alias("section"), F.lit(k).alias("k"), "id", "rank", estimated_tokens(F.col("body")).alias("tokens"))
    graph = part(e, "entity", 0).unionByName(part(d, "edge", 1))
    kept = within_budget(graph.withColumn("side", F.lit(0)), int(budget * 0.65), ["side"], ["k", "rank", "id"])
    talk = within_budget(part(p, "discussion", 2).withColumn("side", F.lit(1)), int(budget * 0.35), ["side"], ["rank", "id"])
    return kept.unionByName(talk).select("section", "id", "tokens", "used")


def tenure(g: Graph) -> DataFrame:
    """(entity_id, first, last): the span of a person's evidence and of the episodes they acted in."""
    people = g.entities.filter("entity_type = 'person'").select(F.col("id").alias("entity_id"), "canonical_name")
    seen = live_evidence(g).select("entity_id", "timestamp")
    acted = people.join(g.episodes.filter("status <> 'redacted'").select(F.col("actor").alias("canonical_name"), "timestamp"), "canonical_name").select("entity_id", "timestamp")
    return seen.unionByName(acted).join(people.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def area_people(g: Graph, prefix: str) -> DataFrame:
    """(owner, score): summed owner confidence in an area, halved for links older than 90 days."""
    area = g.entities.filter(F.col("canonical_name").startswith(prefix + "/")).select(F.col("id").alias("target_id"))
    people = g.entities.filter("entity_type = 'person'").select(F.col("id").alias("source_id"))
    own = active(g.edges).filter("relation_type = 'likely_owner_of'").join(area, "target_id", "left_semi").join(people, "source_id", "left_semi")
    old = F.coalesce(days_between(at(g.now), F.col("valid_from")) > 90, F.lit(False))
    return own.groupBy(F.col("source_id").alias("owner")).agg(F.round(F.sum(F.round(F.when(old, 0.5).otherwise(1.0) * F.col("confidence"), 6)), 2).alias("score"))


def hot_files(g: Graph, prefix: str, k: int = 5) -> DataFrame:
    """(id, heat): how strongly files are drawn in by the co-changes of an area, one more for its own files."""
    anchors = g.entities.filter(F.col("canonical_name").startswith(prefix + "/")).select(F.col("id").alias("entity_id"))
    drawn = top_co_changes(g, k).join(anchors, "entity_id", "left_semi").groupBy(F.col("other").alias("id")).agg(F.sum(F.floor(F.coalesce("weight", F.lit(1.0)) + 0.5)).alias("heat"))
    own = anchors.select(F.col("entity_id").alias("id"), F.lit(1).cast("long").alias("heat"))
    return drawn.unionByName(own).groupBy("id").agg(F.sum("heat").alias("heat"))


def collaborators(g: Graph) -> DataFrame:
    """(a, b, shared): people who own the same things, by the number of things; pairs meet on the thing they own."""
    own = active(g.edges).filter("relation_type = 'likely_owner_of'").select("source_id", "target_id").distinct()
    a = own.select(F.col("source_id").alias("a"), "target_id")
    return a.join(own.select(F.col("source_id").alias("b"), "target_id"), "target_id").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def why(g: Graph, name: str) -> DataFrame:
    """(section, id): first commit, partners in change, owner and episodes of the entity of that name."""
    who = g.entities.filter(F.col("canonical_name") == name).select(F.col("id").alias("entity_id"))
    ep = live_evidence(g).join(who, "entity_id", "left_semi").join(g.episodes.select(F.col("id").alias("episode_id"), "source_type"), "episode_id")
    first = ep.filter("source_type = 'git_commit'").orderBy("timestamp", "episode_id").limit(1).select(F.lit("introduced").alias("section"), F.col("episode_id").alias("id"))
    prs = ep.filter("source_type = 'github_pr'").orderBy(F.desc("timestamp"), "episode_id").limit(10).select(F.lit("pull_request").alias("section"), F.col("episode_id").alias("id"))
    pairs = top_co_changes(g).join(who, "entity_id", "left_semi").select(F.lit("co_change").alias("section"), F.col("other").alias("id"))
    owner = strongest_owner(g).join(who, "entity_id", "left_semi").select(F.lit("owner").alias("section"), F.col("owner").alias("id"))
    return first.unionByName(prs).unionByName(pairs).unionByName(owner)


def brief(g: Graph, episode_id: str) -> DataFrame:
    """(section, id) for a pull request: the entities it touches, their owners, and files that usually change with them but are not in it."""
    inside = g.entity_evidence.filter(F.col("episode_id") == episode_id).select("entity_id").distinct()
    owners = strongest_owner(g).join(inside, "entity_id", "left_semi").select(F.lit("owner").alias("section"), F.col("owner").alias("id")).distinct()
    outside = top_co_changes(g).join(inside, "entity_id", "left_semi").select(F.col("other").alias("entity_id")).distinct().join(inside, "entity_id", "left_anti")
    return inside.select(F.lit("entity").alias("section"), F.col("entity_id").alias("id")).unionByName(owners).unionByName(outside.select(F.lit("outside").alias("section"), F.col("entity_id").alias("id")))


def person(g: Graph, name: str) -> DataFrame:
    """(section, id, value) of a person: what they own, review and with whom they share it."""
    who = g.entities.filter((F.col("canonical_name") == name) & (F.col("entity_type") == "person")).select(F.col("id").alias("p"))
    own = active(g.edges).filter("relation_type = 'likely_owner_of'").join(who, F.col("source_id") == F.col("p")).select(F.lit("owns").alias("section"), F.col("target_id").alias("id"), F.round("confidence", 6).alias("value"))
    rev = active(g.edges).filter("relation_type = 'reviewed_by'").join(who, F.col("target_id") == F.col("p")).select(F.lit("reviewed").alias("section"), F.col("source_id").alias("id"), F.round("confidence", 6).alias("value"))
    col = collaborators(g).join(who, F.col("a") == F.col("p")).select(F.lit("shares").alias("section"), F.col("b").alias("id"), F.col("shared").cast("double").alias("value"))
    return own.unionByName(rev).unionByName(col)


__all__ = ["actor_weights", "area_people", "brief", "collaborators", "context", "greedy", "hot_files", "person", "primary_entities", "snippet", "tenure", "why", "within_budget"]
