"""References in episode texts: patterns in order of precision, lookups, and the edges they make."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass(frozen=True)
class Pattern:
    """Group 1 of the pattern is the id; ref says how the id reads as a source_ref, with $1 for the id."""

    type: str
    regex: str
    ref: str
    confidence: float


# The built-in patterns, in order.
PATTERNS = [
    Pattern("github_pr", r"(?i)https?://github\.com/[^/\s]+/[^/\s]+/pull/(\d+)", "$1", 0.95),
    Pattern("github_issue", r"(?i)https?://github\.com/[^/\s]+/[^/\s]+/issues/(\d+)", "$1", 0.95),
    Pattern("gerrit_change", r"(?i)https?://[^/\s]*googlesource\.com/c/[^/\s]+/\+/(\d+)", "$1", 0.95),
    Pattern("google_doc", r"(?i)https?://docs\.google\.com/document/d/([A-Za-z0-9_-]+)", "$1", 0.95),
    Pattern("linear_issue", r"(?i)https?://linear\.app/[^/\s]+/issue/([A-Z]+-\d+)", "$1", 0.95),
    Pattern("jira_issue", r"(?i)https?://[^/\s]+\.atlassian\.net/browse/([A-Z][A-Z0-9]+-\d+)", "$1", 0.95),
    Pattern("buganizer_issue", r"\bb/(\d{6,})\b", "b/$1", 0.9),
    Pattern("gerrit_change", r"\bgo/cl/(\d+)\b", "go/cl/$1", 0.9),
    Pattern("git_commit", r"(?i)\b([0-9a-f]{40})\b", "$1", 0.9),
    Pattern("git_commit", r"(?i)\b([0-9a-f]{7,11})\b", "$1", 0.75),
    Pattern("github_issue", r"#(\d+)\b", "#$1", 0.85),
]


def registered(extra: list[Pattern]) -> list[Pattern]:
    """The built-in patterns and more, such as a plugin's; a pattern that is there already for its type is an error."""
    known = {(p.type, p.regex) for p in PATTERNS}
    for p in extra:
        re.compile(p.regex)
        if (p.type, p.regex) in known:
            raise ValueError(f"pattern exists already: {p.type} {p.regex}")
        known.add((p.type, p.regex))
    return [*PATTERNS, *extra]


def _ref(p: Pattern) -> Column:
    x = F.col("id_")
    if p.type == "git_commit":
        x = F.lower(x)
    before, _, after = p.ref.partition("$1")
    return F.concat(F.lit(before), x, F.lit(after))


def references(texts: DataFrame, id: str = "id", content: str = "content", patterns: list[Pattern] = PATTERNS) -> DataFrame:
    """(episode_id, type, ref, confidence): each reference of a text once, by the first pattern that finds it. One scan for all patterns."""
    found = F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_extract_all(content, F.lit(p.regex), 1).alias("ids")) for i, p in enumerate(patterns)])
    rows = texts.filter(F.col(content).isNotNull()).select(F.col(id).alias("episode_id"), F.explode(found).alias("f")).select("episode_id", "f.i", F.explode("f.ids").alias("id_"))
    which = lambda f: F.element_at(F.array(*[f(p) for p in patterns]), F.col("i") + 1)
    named = rows.select("episode_id", "i", which(lambda p: F.lit(p.type)).alias("type"), which(_ref).alias("ref"), which(lambda p: F.lit(p.confidence)).alias("confidence"))
    first = named.groupBy("episode_id", "type", "ref").agg(F.min(F.struct("i", "confidence")).alias("m"))
    return first.select("episode_id", "type", "ref", F.col("m.confidence").alias("confidence"))


def primary_entities(g: Graph) -> DataFrame:
    """(episode_id, entity_id): the entity an episode is most surely evidence for."""
    w = Window.partitionBy("episode_id").orderBy(F.desc("confidence"), "entity_id")
    best = g.entity_evidence.groupBy("episode_id", "entity_id").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("r", F.row_number().over(w)).filter("r = 1").select("episode_id", "entity_id")


def resolved(g: Graph, refs: DataFrame) -> DataFrame:
    """refs with target_episode and target_entity; both null where unresolved.

    A reference is looked up as an episode's source_ref of its type; #N also as an issue or pull request address that ends in N. Redacted
    episodes are no targets. Of several the current, then the newest counts.
    """
    ep = g.episodes.filter("status <> 'redacted' and source_ref is not null")
    number = F.coalesce(F.expr("nullif(regexp_extract(source_ref, '/issues/([0-9]+)$', 1), '')"), F.expr("nullif(regexp_extract(source_ref, '/pull/([0-9]+)$', 1), '')"))
    keys = ep.select("id", "superseded_by", "timestamp", F.explode(F.array(F.concat_ws("|", "source_type", "source_ref"), F.when(F.col("source_type").isin("github_issue", "github_pr"), F.concat(F.lit("github_issue|#"), number)))).alias("key")).filter("key is not null")
    best = keys.groupBy("key").agg(F.max(F.struct(F.col("superseded_by").isNull().cast("int").alias("current"), "timestamp", "id")).alias("m")).select("key", F.col("m.id").alias("target_episode"))
    joined = refs.withColumn("key", F.concat_ws("|", "type", "ref")).join(best, "key", "left").drop("key")
    primary = primary_entities(g).select(F.col("episode_id").alias("target_episode"), F.col("entity_id").alias("target_entity"))
    return joined.join(primary, "target_episode", "left")


def reference_edges(g: Graph, refs: DataFrame) -> DataFrame:
    """(source_entity, target_entity, n_episodes, confidence): one edge for each pair of entities, never to itself; its episodes are its evidence."""
    rows = resolved(g, refs).filter("target_entity is not null and target_episode <> episode_id").join(primary_entities(g), "episode_id")
    rows = rows.filter("entity_id <> target_entity")
    return rows.groupBy(F.col("entity_id").alias("source_entity"), "target_entity").agg(F.countDistinct("episode_id").alias("n_episodes"), F.max("confidence").alias("confidence"))


def unresolved(g: Graph, refs: DataFrame) -> DataFrame:
    return resolved(g, refs).filter("target_episode is null").select("episode_id", "type", "ref")


def drained(g: Graph, pending: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Pending references (episode_id, type, ref) that resolve by now."""
    rows = resolved(g, pending.withColumn("confidence", F.lit(confidence)))
    return rows.filter("target_episode is not null and target_episode <> episode_id").select("episode_id", "type", "ref", "target_episode", "confidence")
