"""Derived documents: their inputs, fingerprints, staleness and renewal, and what has come in since the last round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, active, at

# The built-in kinds of documents and what they are anchored to.
KINDS = {"entity_summary": "entity", "decision_page": "none", "contradiction_report": "none", "topic_cluster": "none"}


def entity_hash() -> Column:
    return F.sha2(F.concat_ws(": ", "canonical_name", F.expr("nullif(summary, '')")), 256)


def current_hashes(g: Graph) -> DataFrame:
    """(target_type, target_id, hash): null for what is redacted, archived or invalidated; absent rows are absent."""
    e = g.entities.select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id"), F.when(F.col("status") == "active", entity_hash()).alias("hash"))
    p = g.episodes.select(F.lit("episode").alias("target_type"), F.col("id").alias("target_id"), F.when(F.col("status") != "redacted", F.col("content_hash")).alias("hash"))
    d = g.edges.select(F.lit("edge").alias("target_type"), F.col("id").alias("target_id"), F.when(F.col("invalidated_at").isNull(), F.sha2("fact", 256)).alias("hash"))
    return e.unionByName(p).unionByName(d)


def default_inputs(g: Graph, anchors: DataFrame) -> DataFrame:
    """(projection_id, target_type, target_id) for anchors (projection_id, entity_id, as_of): the entity, its evidence and its edges, as known then."""
    own = anchors.select("projection_id", F.lit("entity").alias("target_type"), F.col("entity_id").alias("target_id"))
    ep = g.episodes.select(F.col("id").alias("episode_id"), "ingested_at")
    ev = g.entity_evidence.select("entity_id", "episode_id").distinct().join(anchors, "entity_id").join(ep, "episode_id").filter("ingested_at <= as_of")
    ed = g.touching.join(anchors, "entity_id").filter("created_at <= as_of and (invalidated_at is null or invalidated_at > as_of)")
    out = own.unionByName(ev.select("projection_id", F.lit("episode").alias("target_type"), F.col("episode_id").alias("target_id"))).unionByName(ed.select("projection_id", F.lit("edge").alias("target_type"), F.col("id").alias("target_id")))
    return out.distinct()


def stored(g: Graph, inputs: DataFrame) -> DataFrame:
    """Inputs with the hash they had when the document was written: contents are immutable, so it is the hash whatever the state is now."""
    e = g.entities.select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id"), entity_hash().alias("stored_hash"))
    p = g.episodes.select(F.lit("episode").alias("target_type"), F.col("id").alias("target_id"), F.col("content_hash").alias("stored_hash"))
    d = g.edges.select(F.lit("edge").alias("target_type"), F.col("id").alias("target_id"), F.sha2("fact", 256).alias("stored_hash"))
    return inputs.join(e.unionByName(p).unionByName(d), ["target_type", "target_id"], "left")


def fingerprint(inputs: DataFrame, hash: str) -> DataFrame:
    """(projection_id, fingerprint): SHA-256 over the sorted lines type:id:hash, a missing hash being empty."""
    line = F.concat_ws(":", "target_type", "target_id", F.coalesce(hash, F.lit("")))
    return inputs.groupBy("projection_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def staleness(g: Graph, inputs: DataFrame) -> DataFrame:
    """(projection_id, stale, reason, n_deleted, n_changed): all documents in one pass; inputs: (projection_id, target_type, target_id, stored_hash)."""
    now = inputs.join(current_hashes(g), ["target_type", "target_id"], "left")
    counts = now.groupBy("projection_id").agg(F.count_if(F.col("hash").isNull() & F.col("stored_hash").isNotNull()).alias("n_deleted"), F.count_if(F.col("hash").isNotNull() & (F.col("hash") != F.coalesce("stored_hash", F.lit("")))).alias("n_changed"))
    reason = F.when(F.col("n_deleted") > 0, "input_deleted").when(F.col("n_changed") > 0, "input_content_changed")
    return counts.select("projection_id", (F.col("n_deleted") + F.col("n_changed") > 0).alias("stale"), reason.alias("reason"), "n_deleted", "n_changed")


def module_pages(g: Graph) -> DataFrame:
    """(projection_id, entity_id, as_of): one summary page for each module, written a year after the module was created."""
    return g.entities.filter("entity_type = 'module'").select(F.concat(F.lit("page:"), "id").alias("projection_id"), F.col("id").alias("entity_id"), (F.col("created_at") + F.expr("interval 365 days")).alias("as_of"))


def delta(g: Graph, since: str, summary: int = 200) -> DataFrame:
    """(item, id, at, summary): episodes, entities and edges that came after the cursor."""
    t = at(since)
    p = g.episodes.filter(F.col("ingested_at") > t).select(F.lit("episode").alias("item"), "id", F.col("ingested_at").alias("at"), F.substring("content", 1, summary).alias("summary"))
    e = g.entities.filter(F.col("created_at") > t).select(F.lit("entity").alias("item"), "id", F.col("created_at").alias("at"), F.substring("canonical_name", 1, summary).alias("summary"))
    d = active(g.edges).filter(F.col("created_at") > t).select(F.lit("edge").alias("item"), "id", F.col("created_at").alias("at"), F.substring("fact", 1, summary).alias("summary"))
    return p.unionByName(e).unionByName(d)


def sampled_delta(g: Graph, since: str, most: int = 500) -> DataFrame:
    """The newest of each kind in proportion, at least one; the whole delta if it is no larger. A sampling operator by purpose."""
    rows = delta(g, since)
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = counts.crossJoin(F.broadcast(total)).select("item", F.when(F.col("total") <= most, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(most * F.col("n") / F.col("total") + 0.5))).cast("long").alias("take"))
    w = Window.partitionBy("item").orderBy(F.desc("at"), F.desc("id"))
    # no kind takes more than `most`: a fixed bound, which is applied before the rows are shuffled
    newest = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return newest.join(F.broadcast(share), "item").filter("r <= take").select("item", "id")


def unknown_ids(g: Graph, proposed: DataFrame) -> DataFrame:
    """Proposed inputs (target_type, target_id) that do not exist."""
    return proposed.join(current_hashes(g).select("target_type", "target_id"), ["target_type", "target_id"], "left_anti")


def renew(g: Graph, inputs: DataFrame, judge: Callable[[dict], str], budget: int) -> list[tuple[str, str]]:
    """(projection_id, verdict) for stale documents, at most `budget` of them: still_accurate refreshes, anything else supersedes.

    The judge (a model outside) is called once for each stale document, so the loop is bounded by the budget, not by the data.
    """
    rows = staleness(g, inputs).filter("stale").orderBy("projection_id").limit(budget).collect()
    return [(r["projection_id"], judge(r.asDict())) for r in rows]
