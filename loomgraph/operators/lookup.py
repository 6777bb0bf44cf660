"""Point lookups, name and path resolution, evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, at, valid_at


def find_entities(g: Graph, type: str | None = None, name: str | None = None, status: str | None = None) -> DataFrame:
    e = g.entities
    for column, value in (("entity_type", type), ("canonical_name", name), ("status", status)):
        if value is not None:
            e = e.filter(F.col(column) == value)
    return e


def current_episodes(g: Graph) -> DataFrame:
    """The episode each (source_type, source_ref) stands at: not superseded."""
    return g.episodes.filter("source_ref is not null and superseded_by is null")


def resolve_entities(g: Graph, names: DataFrame, type: str | None = None) -> DataFrame:
    """(name, entity_id, via): the oldest entity of that canonical name, else the one with the newest alias that is valid now."""
    e = g.entities if type is None else g.entities.filter(F.col("entity_type") == type)
    wanted = names.select("name").filter("name is not null").distinct()
    exact = wanted.join(e, F.col("name") == F.col("canonical_name")).select("name", F.col("id").alias("entity_id"), F.lit(0).alias("via"), F.lit(None).cast("timestamp_ntz").alias("alias_at"), F.col("created_at").alias("entity_at"), F.lit("").alias("alias_id"))
    live = g.aliases.filter(valid_at(at(g.now))).select("alias", "entity_id", F.col("created_at").alias("alias_at"), F.col("id").alias("alias_id"))
    by_alias = wanted.join(live, F.col("name") == F.col("alias")).join(e.select(F.col("id").alias("entity_id"), F.col("created_at").alias("entity_at")), "entity_id")
    both = exact.unionByName(by_alias.select("name", "entity_id", F.lit(1).alias("via"), "alias_at", "entity_at", "alias_id"))
    w = Window.partitionBy("name").orderBy("via", F.col("alias_at").desc_nulls_last(), "entity_at", "entity_id", "alias_id")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "entity_id", F.when(F.col("via") == 0, "name").otherwise("alias").alias("via"))


def evidence_of_entities(g: Graph) -> DataFrame:
    ep = g.episodes.select(F.col("id").alias("episode_id"), "source_type", "source_ref", "status", "timestamp")
    return g.entity_evidence.select("entity_id", "episode_id", "extractor", "confidence").join(ep, "episode_id")


def path_targets(g: Graph, path: str, limit: int = 10) -> DataFrame:
    """(id, canonical_name, step): exact name, else files and modules that end in it, else anything that does; shortest names first."""
    lower = F.lower("canonical_name")
    step = F.when(F.col("canonical_name") == path, 0).when(lower.endswith(path.lower()) & F.col("entity_type").isin("file", "module"), 1).when(lower.endswith(path.lower()), 2)
    hits = g.entities.filter("status = 'active'").select("id", "canonical_name", step.alias("step")).filter("step is not null")
    best = hits.agg(F.min("step").alias("best"))
    return hits.join(F.broadcast(best), hits["step"] == best["best"]).drop("best").orderBy(F.length("canonical_name"), "canonical_name", "id").limit(limit)


def symbol_targets(g: Graph, symbol: str, limit: int = 20) -> DataFrame:
    lower, s = F.lower("canonical_name"), symbol.lower()
    step = F.when(F.col("canonical_name") == symbol, 0).when(lower.endswith("::" + s), 1).when(lower.contains(s), 2)
    hits = g.entities.filter("status = 'active' and entity_type = 'symbol'").select("id", "canonical_name", step.alias("step")).filter("step is not null")
    best = hits.agg(F.min("step").alias("best"))
    return hits.join(F.broadcast(best), hits["step"] == best["best"]).drop("best").orderBy(F.length("canonical_name"), "canonical_name", "id").limit(limit)


def area_children(g: Graph, prefix: str) -> DataFrame:
    return g.entities.filter(F.col("canonical_name").startswith(prefix.rstrip("/") + "/"))


def episode_by_number(g: Graph, number: int) -> DataFrame:
    """The episode a pull request or issue number means: the number itself, #number, then a pull or issue address; the oldest of each."""
    n = str(number)
    rank = F.when(F.col("source_ref") == n, 0).when(F.col("source_ref") == f"#{n}", 1).when(F.col("source_ref").endswith(f"/pull/{n}"), 2).when(F.col("source_ref").endswith(f"/issues/{n}"), 3)
    return g.episodes.select("id", "source_ref", "timestamp", rank.alias("rank")).filter("rank is not null").orderBy("rank", "timestamp", "id").limit(1).select("id", "source_ref", "rank")


def parse_target(text: str) -> dict:
    """path, path:line or symbol."""
    if m := re.fullmatch(r"(.+\.[A-Za-z0-9]+):(\d+)", text):
        return {"kind": "path_line", "path": m[1], "line": int(m[2])}
    if "/" in text or re.search(r"\.[A-Za-z0-9]{1,5}$", text):
        return {"kind": "path", "path": text}
    return {"kind": "symbol", "symbol": text}


def without_noise(df: DataFrame, name: str = "canonical_name") -> DataFrame:
    """Leaves out all-capital symbols, lock files, build output and tests."""
    base = F.element_at(F.split(name, "/"), -1)
    noise = F.col(name).rlike(r"::[A-Z0-9_]+$") | base.isin("package-lock.json", "yarn.lock", "bun.lock", "Cargo.lock", "go.sum") | F.col(name).rlike(r"(^|/)(dist|build|node_modules|test|tests)/")
    return df.filter(~noise)


def masked_episodes(g: Graph) -> DataFrame:
    """Episodes as they may be shown: a redacted one keeps its id and status only."""
    hide = F.col("status") == "redacted"
    shown = ["source_type", "source_ref", "content_hash", "actor"]
    return g.episodes.select("id", "status", *[F.when(~hide, F.col(c)).alias(c) for c in shown])


def neighbourhood_view(g: Graph, types: list[str], relations: list[str], min_degree: int) -> DataFrame:
    """Entities left after type and relation filters, endpoint cascade and a least visible degree."""
    e = g.entities.filter(F.col("entity_type").isin(types)).select("id", "canonical_name")
    ids = e.select(F.col("id").alias("x"))
    edges = g.edges.filter("invalidated_at is null").filter(F.col("relation_type").isin(relations)).join(ids, F.col("source_id") == F.col("x"), "left_semi").join(ids, F.col("target_id") == F.col("x"), "left_semi")
    degree = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return e.join(degree.filter(F.col("degree") >= min_degree), "id")
