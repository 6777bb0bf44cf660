"""Full-text, vector and composite search over entities, edges and episodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25, query_phrases, snippet
from ..graph import Graph, active, at, days_between, known_at, valid_at
from .traverse import reach

# The weights of the components of a composite score.
WEIGHTS = {"fulltext": (0.40, 0.30, 0.20, 0.10, 0.0), "hybrid": (0.35, 0.25, 0.15, 0.10, 0.15)}
HALF_LIFE = 30


def temporal_score(now: Column, then: Column) -> Column:
    """Halves every 30 days; the future counts as now."""
    return F.exp(-F.greatest(F.lit(0.0), days_between(now, then)) * math.log(2) / HALF_LIFE)


def evidence_score(n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n) / math.log1p(100)))


def graph_score(degree: Column) -> Column:
    return F.when(degree <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(degree) / math.log1p(50)))


def composite(fts: Column, evidence: Column, time: Column, graph: Column, vector: Column, mode: str = "fulltext") -> Column:
    return sum((w * c for w, c in zip(WEIGHTS[mode], (fts, evidence, time, graph, vector))), F.lit(0.0))


def normalized(ranks: DataFrame) -> DataFrame:
    """Adds fts: min-max over the hits, best 1, worst 0, a single or equal ones 1. Minimum and maximum come from an aggregate, not from one window over all."""
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    fts = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("hi") - F.col("rank")) / (F.col("hi") - F.col("lo")))
    return ranks.crossJoin(F.broadcast(ends)).withColumn("fts", fts).drop("lo", "hi")


def entity_text() -> Column:
    return F.concat_ws(" ", "canonical_name", "summary")


def search_entities(g: Graph, query: str, types: list[str] | None = None, any_term: bool = False) -> DataFrame:
    """Ranks come from the whole table, the filters after it."""
    hits = bm25(g.entities, "id", entity_text(), query_phrases(query), any_term)
    kept = g.entities.filter("status = 'active'")
    if types:
        kept = kept.filter(F.col("entity_type").isin(types))
    return hits.join(kept.select("id"), "id", "left_semi")


def search_edges(g: Graph, query: str, kinds: list[str] | None = None, valid: str | None = None, as_of: str | None = None, include_invalidated: bool = False, any_term: bool = False) -> DataFrame:
    kept = g.edges
    if as_of is not None:
        kept = kept.filter(known_at(at(as_of)))
    elif not include_invalidated:
        kept = active(kept)
    if kinds:
        kept = kept.filter(F.col("edge_kind").isin(kinds))
    if valid is not None:
        kept = kept.filter(valid_at(at(valid)))
    return bm25(g.edges, "id", F.col("fact"), query_phrases(query), any_term).join(kept.select("id"), "id", "left_semi")


def search_episodes(g: Graph, query: str, any_term: bool = False) -> DataFrame:
    return bm25(g.episodes, "id", F.col("content"), query_phrases(query), any_term).join(g.episodes.filter("status = 'active'").select("id"), "id", "left_semi")


def like_fallback(g: Graph, term: str, limit: int = 10) -> DataFrame:
    """Entities whose name holds the term, or, for longer terms, the term without its last letter; shortest names first."""
    n, t = F.lower("canonical_name"), term.lower()
    hit = n.contains(t) | (n.contains(t[:-1]) if len(t) > 6 else F.lit(False))
    return g.entities.filter("status = 'active'").filter(hit).select("id", "canonical_name", F.lit(-0.5).alias("rank")).orderBy(F.length("canonical_name"), "canonical_name", "id").limit(limit)


def discussions(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Episodes that match any term: pull requests, then issues, then commits, then by rank."""
    kind = F.when(F.col("source_type") == "github_pr", 0).when(F.col("source_type") == "github_issue", 1).when(F.col("source_type") == "git_commit", 2).otherwise(3)
    hits = search_episodes(g, query, any_term=True).join(g.episodes.select("id", "source_type"), "id")
    return hits.orderBy(kind, "rank", "id").limit(limit).select("id", "source_type", "rank")


def discussion_confidence(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Rank share and a prior by source, three to one."""
    rows = discussions(g, query, limit)
    best = rows.agg(F.min("rank").alias("best"))
    prior = F.when(F.col("source_type") == "github_pr", 1.0).when(F.col("source_type") == "github_issue", 0.9).when(F.col("source_type") == "git_commit", 0.7).otherwise(0.6)
    share = F.when(F.col("best") == 0, 0.0).otherwise(F.abs("rank") / F.abs("best"))
    return rows.crossJoin(F.broadcast(best)).select("id", "source_type", F.round(0.75 * share + 0.25 * prior, 6).alias("confidence"))


def episode_fallback(g: Graph, terms: list[str], limit: int = 10) -> DataFrame:
    """(id, canonical_name, rank): entities behind episodes that hold all terms, better the more their own name is spoken of.

    -0.5 if the name holds a term, -0.45 if its stem occurs five times or more in those episodes, -0.35 if it does at all, else -0.3.
    """
    body = F.lower("content")
    ep = g.episodes.filter("status = 'active'").select(F.col("id").alias("episode_id"), body.alias("body"))
    for t in terms:
        ep = ep.filter(F.col("body").contains(t.lower()))
    e = g.entities.filter("status = 'active'").select(F.col("id").alias("entity_id"), "canonical_name", F.lower(F.regexp_extract("canonical_name", r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)).alias("stem"))
    met = g.entity_evidence.select("entity_id", "episode_id").distinct().join(ep, "episode_id").join(e, "entity_id")
    times = F.when(F.length("stem") > 0, (F.length("body") - F.length(F.replace("body", F.col("stem"), F.lit("")))) / F.length("stem")).otherwise(0)
    rows = met.groupBy("entity_id", "canonical_name").agg(F.sum(times).alias("n"))
    named = F.lit(False)
    for t in terms:
        named = named | F.lower("canonical_name").contains(t.lower())
    rank = F.when(named, -0.5).when(F.col("n") >= 5, -0.45).when(F.col("n") >= 1, -0.35).otherwise(-0.3)
    return rows.select(F.col("entity_id").alias("id"), "canonical_name", rank.alias("rank")).orderBy("rank", F.length("canonical_name"), "canonical_name", "id").limit(limit)


def shares(ranks: DataFrame) -> DataFrame:
    """Adds share: a rank's size over the best one's."""
    best = ranks.agg(F.min("rank").alias("best"))
    return ranks.crossJoin(F.broadcast(best)).withColumn("share", F.when(F.col("best") == 0, 0.0).otherwise(F.round(F.abs("rank") / F.abs("best"), 6))).drop("best")


def cosine(a: str, b: str) -> Column:
    """Clamped to [0, 1]; 0 for empty or zero vectors and different lengths. Sums run in element order, in doubles."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def similar_to(g: Graph, embedding_id: str, limit: int = 20, least: float = 0.0, target_type: str | None = None) -> DataFrame:
    """Embeddings of the same model nearest to a given one: one vector against all rows, then a top-k that needs no full sort."""
    q = g.embeddings.filter(F.col("id") == embedding_id).select(F.col("vector").alias("q"), F.col("model").alias("qm"), F.col("id").alias("qid"))
    rows = g.embeddings if target_type is None else g.embeddings.filter(F.col("target_type") == target_type)
    rows = rows.crossJoin(F.broadcast(q)).filter("model = qm and id <> qid").select("id", "target_type", "target_id", F.round(cosine("vector", "q"), 6).alias("score"))
    return rows.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def latest_embeddings(g: Graph) -> DataFrame:
    """Upsert by (target_type, target_id, model): the newest row of each."""
    w = Window.partitionBy("target_type", "target_id", "model").orderBy(F.desc("created_at"), F.desc("id"))
    return g.embeddings.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def embedding_gap(g: Graph, model: str) -> DataFrame:
    """(target_type, target_id) of active entities and episodes without an embedding of the model."""
    have = g.embeddings.filter(F.col("model") == model).select("target_type", "target_id").distinct()
    want = g.entities.filter("status = 'active'").select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id")).unionByName(g.episodes.filter("status = 'active'").select(F.lit("episode").alias("target_type"), F.col("id").alias("target_id")))
    return want.join(have, ["target_type", "target_id"], "left_anti")


def search(g: Graph, query: str, limit: int | None = 20, least: float = 0.0, valid: str | None = None, types: list[str] | None = None, kinds: list[str] | None = None, include_invalidated: bool = False, hops: int = 2, mode: str = "fulltext", like: str | None = None) -> DataFrame:
    """(type, id, score, fts, evidence, temporal, graph, vector, content): hits of all three kinds and what is linked to entity hits.

    hybrid mode takes the embedding `like` as the query's vector. Evidence counts, degrees and vector scores are aggregated once for
    each table and joined to the hits, of which there are few.
    """
    now = at(g.now)
    ev = g.entity_evidence.select("entity_id", "episode_id").distinct()
    hits = normalized(search_entities(g, query, types))
    walked = reach(g, hits.select("id", F.col("fts").alias("seed_score")), hops, valid)
    walked = walked.join(hits.select("id"), "id", "left_anti").select("id", (F.col("seed_score") * F.when(F.col("hops") == 1, 0.85).otherwise(0.55)).alias("fts"))
    if types:
        walked = walked.join(g.entities.filter(F.col("entity_type").isin(types)).select("id"), "id", "left_semi")
    found = hits.select("id", "fts").unionByName(walked)
    vectors = g.spark.createDataFrame([], "target_type string, target_id string, score double")
    if mode == "hybrid":
        vectors = similar_to(g, like, 100, target_type="entity").unionByName(similar_to(g, like, 100, target_type="episode")).groupBy("target_type", "target_id").agg(F.max("score").alias("score"))
    ep_vector = vectors.filter("target_type = 'episode'").select(F.col("target_id").alias("episode_id"), "score")
    own = vectors.filter("target_type = 'entity'").select(F.col("target_id").alias("id"), F.col("score").alias("own"))
    n_ev = ev.join(found.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(ep_vector, "episode_id", "left").groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_ev"), F.max("score").alias("via"))
    degree = active(g.touching).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    zero = F.lit(0.0)
    part = lambda df, kind, time, evidence, graph, vector, content: df.select(F.lit(kind).alias("type"), "id", F.col("fts"), evidence.alias("evidence"), temporal_score(now, F.col(time)).alias("temporal"), graph.alias("graph"), vector.alias("vector"), content.alias("content"))
    e = found.join(g.entities.select("id", "canonical_name", "updated_at"), "id").join(n_ev, "id", "left").join(degree, "id", "left").join(own, "id", "left")
    entities = part(e, "entity", "updated_at", evidence_score(F.coalesce("n_ev", F.lit(0))), graph_score(F.coalesce("degree", F.lit(0))), F.coalesce(F.greatest("own", "via"), zero), F.col("canonical_name"))
    edge_ev = g.edge_evidence.groupBy(F.col("edge_id").alias("id")).agg(F.count(F.lit(1)).alias("n_ev"))
    d = normalized(search_edges(g, query, kinds, valid, include_invalidated=include_invalidated)).join(g.edges.select("id", "fact", "created_at"), "id").join(edge_ev, "id", "left")
    # an edge has no embedding, so its vector score is 0
    edges = part(d, "edge", "created_at", evidence_score(F.coalesce("n_ev", F.lit(0))), zero, zero, F.col("fact"))
    p = normalized(search_episodes(g, query)).join(g.episodes.select("id", "content", "timestamp"), "id").join(ep_vector.withColumnRenamed("episode_id", "id"), "id", "left")
    episodes = part(p, "episode", "timestamp", F.lit(1.0), zero, F.coalesce("score", zero), snippet(F.col("content")))
    rows = entities.unionByName(edges).unionByName(episodes)
    rows = rows.withColumn("score", F.round(composite(*[F.col(c) for c in ("fts", "evidence", "temporal", "graph", "vector")], mode), 6))
    rows = rows.select("type", "id", "score", *[F.round(c, 6).alias(c) for c in ("fts", "evidence", "temporal", "graph", "vector")], "content").filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "type", "id").limit(limit) if limit is not None else rows


def anchored(g: Graph, name: str, hops: int = 2, valid: str | None = None) -> DataFrame:
    """(id, tier, score): the entity of that name or alias at 1.0, its neighbours in [.5, 1], those beyond below .5, each by confidence within its tier."""
    from .lookup import resolve_entities

    anchor = resolve_entities(g, g.spark.createDataFrame([(name,)], "name string")).select(F.col("entity_id").alias("id"), F.lit(1.0).alias("seed_score"))
    walked = reach(g, anchor, hops, valid)
    tiers = walked.withColumn("tier", F.least(F.col("hops"), F.lit(2)))
    top = tiers.join(F.broadcast(tiers.groupBy("tier").agg(F.max("confidence").alias("best"))), "tier")  # two rows
    share = F.when(F.col("best") == 0, 1.0).otherwise(F.col("confidence") / F.col("best"))
    scored = top.select("id", "tier", F.round(F.when(F.col("tier") == 1, 0.5 + 0.5 * share).otherwise(0.5 * share), 6).alias("score"))
    return anchor.select("id", F.lit(0).alias("tier"), F.lit(1.0).alias("score")).unionByName(scored)
