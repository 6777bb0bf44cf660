"""Derived documents as rows: writing and replacing them, what holds at a time, searching and checking them, and rounds of renewal.

A page has the columns of the stored projections table; its inputs are rows (projection_id, target_type, target_id, content_hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25, query_phrases
from ..graph import Graph, at, valid_at
from .projections import KINDS, current_hashes, fingerprint
from .traverse import cycles


class InputMissing(ValueError):
    pass


class Cycle(ValueError):
    pass


def live(pages: DataFrame) -> DataFrame:
    return pages.filter("invalidated_at is null")


def pages_at(pages: DataFrame, moment: str) -> DataFrame:
    """Begun, not ended and not invalidated by then."""
    t = at(moment)
    return pages.filter((F.col("valid_from") <= t) & valid_at(t) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t)))


def reversals(pages: DataFrame, a: str, b: str) -> DataFrame:
    """Decision pages that held at a and were superseded by b."""
    gone = pages_at(pages, b).select("id")
    return pages_at(pages, a).filter("kind = 'decision_page' and superseded_by is not null").join(gone, "id", "left_anti")


def search_pages(pages: DataFrame, query: str) -> DataFrame:
    """Words are always taken as words, never as search syntax."""
    return bm25(pages, "id", F.concat_ws(" ", "title", "body"), query_phrases(query)).join(live(pages).select("id"), "id", "left_semi")


def checked_inputs(g: Graph, inputs: DataFrame) -> DataFrame:
    """Inputs with their current hashes, after a check that each is there and usable."""
    now = inputs.join(current_hashes(g), ["target_type", "target_id"], "left")
    bad = now.filter("hash is null and target_type <> 'projection'").select("target_type", "target_id").limit(3).collect()
    if bad:
        raise InputMissing(f"missing, redacted, archived or invalidated: {[tuple(r) for r in bad]}")
    return now


def write(g: Graph, pages: DataFrame, evidence: DataFrame, drafts: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, evidence) after drafts (id, kind, anchor_type, anchor_id, title, body, model, confidence) were written from their inputs.

    A draft whose inputs have the fingerprint of the live page of the same kind and anchor changes nothing; else that page is closed and
    points to the new one. Drafts that would depend on themselves are an error.
    """
    depends = evidence.filter("target_type = 'projection'").select("projection_id", "target_id").unionByName(inputs.filter("target_type = 'projection'").select("projection_id", "target_id"))
    if not cycles(depends, "projection_id", "target_id").isEmpty():
        raise Cycle("a page depends on itself")
    state = checked_inputs(g, inputs)
    prints = fingerprint(state, "hash").withColumnRenamed("projection_id", "id")
    drafted = drafts.join(prints, "id")
    held = live(pages).select(F.col("kind").alias("k"), F.col("anchor_type").alias("t"), F.col("anchor_id").alias("a"), F.col("id").alias("old"), F.col("input_fingerprint").alias("was"))
    same = (F.col("kind") == F.col("k")) & F.col("anchor_type").eqNullSafe(F.col("t")) & F.col("anchor_id").eqNullSafe(F.col("a"))
    fresh = drafted.join(held, same, "left").filter(F.col("was").isNull() | (F.col("was") != F.col("fingerprint")))
    now = at(g.now)
    new = fresh.select("id", "kind", "anchor_type", "anchor_id", "title", "body", F.lit("markdown").alias("body_format"), "model", F.col("fingerprint").alias("input_fingerprint"), "confidence", now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.lit(None).cast("timestamp_ntz").alias("invalidated_at"), F.lit(None).cast("string").alias("superseded_by"), now.alias("created_at"), F.lit(None).cast("string").alias("owner_id"))
    by = fresh.filter("old is not null").select("old", F.col("id").alias("by"))
    old = pages.join(by, F.col("id") == F.col("old"), "left")
    closed = {"valid_until": F.when(F.col("by").isNull(), F.col("valid_until")).otherwise(now), "invalidated_at": F.when(F.col("by").isNull(), F.col("invalidated_at")).otherwise(now), "superseded_by": F.coalesce("by", "superseded_by")}
    seen = state.join(fresh.select(F.col("id").alias("projection_id")), "projection_id", "left_semi").select("projection_id", "target_type", "target_id", F.lit("input").alias("role"), F.col("hash").alias("content_hash"))
    return old.withColumns(closed).select(*pages.columns).unionByName(new.select(*pages.columns)), evidence.unionByName(seen)


def refreshed(pages: DataFrame, evidence: DataFrame, inputs_now: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages found still accurate take the fingerprint and hashes (projection_id, target_type, target_id, hash) of the present."""
    mine = inputs_now.join(ids.select(F.col("id").alias("projection_id")), "projection_id", "left_semi")
    prints = fingerprint(mine, "hash").select(F.col("projection_id").alias("pid"), "fingerprint")
    out = pages.join(prints, F.col("id") == F.col("pid"), "left").withColumn("input_fingerprint", F.coalesce("fingerprint", "input_fingerprint")).select(*pages.columns)
    keys = ["projection_id", "target_type", "target_id"]
    return out, evidence.join(mine.select(*keys, F.col("hash").alias("h"), F.lit(True).alias("hit")), keys, "left").withColumn("content_hash", F.when(F.col("hit"), F.col("h")).otherwise(F.col("content_hash"))).select(*evidence.columns)


def page_checks(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """(check_name, item_id): pages without inputs, loops of replacement and of dependence."""
    bare = pages.join(evidence.filter("role = 'input'").select(F.col("projection_id").alias("id")), "id", "left_anti").select(F.lit("page_without_input").alias("check_name"), F.col("id").alias("item_id"))
    loops = cycles(pages, "id", "superseded_by").select(F.lit("page_supersession_loop").alias("check_name"), F.col("cycle").alias("item_id"))
    depends = cycles(evidence.filter("target_type = 'projection'"), "projection_id", "target_id").select(F.lit("page_dependency_loop").alias("check_name"), F.col("cycle").alias("item_id"))
    return bare.unionByName(loops).unionByName(depends)


def round_cursor(runs: DataFrame, scope: str | None) -> DataFrame:
    """(started_at) of the last finished round of that scope, dry runs aside; a null scope is a scope."""
    done = runs.filter("status = 'completed' and not coalesce(dry_run, false)").filter(F.col("scope").eqNullSafe(F.lit(scope).cast("string")))
    return done.agg(F.max("started_at").alias("started_at"))


def parse_scope(text: str | None) -> dict:
    """kind:<kind>, anchor:<type>:<id>, or nothing for all."""
    if not text:
        return {}
    head, _, rest = text.partition(":")
    if head == "kind" and rest:
        return {"kind": rest}
    if head == "anchor" and ":" in rest:
        kind, _, id_ = rest.partition(":")
        return {"anchor_type": kind, "anchor_id": id_}
    raise ValueError(f"not a scope: {text!r}")


def proposal_errors(p: dict) -> list[str]:
    """What is wrong with a proposed page."""
    out = []
    if p.get("kind") not in KINDS:
        out.append("kind")
    if p.get("anchor_type") not in ("entity", "edge", "episode", "projection", "none"):
        out.append("anchor_type")
    elif (p["anchor_type"] == "none") != (p.get("anchor_id") is None):
        out.append("anchor_id")
    if not p.get("title"):
        out.append("title")
    if not p.get("inputs"):
        out.append("inputs")
    return out


def round_scores(labels: DataFrame) -> DataFrame:
    """(recall, precision, f1, latency) of a staleness detector; labels: (expected, found, latency_ms)."""
    tp, fp, fn = (F.count_if(c) for c in (F.expr("expected and found"), F.expr("not expected and found"), F.expr("expected and not found")))
    rows = labels.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.avg(F.when(F.expr("expected and found"), F.col("latency_ms"))).alias("latency"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return rows.select("tp", "fp", "fn", "recall", "precision", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")).alias("f1"), "latency")


class ModelMismatch(ValueError):
    pass


def check_model(recorded: str | None, used: str) -> bool:
    """False if nothing is recorded yet; vectors of two models must not mix."""
    if recorded is not None and recorded != used:
        raise ModelMismatch(f"{recorded} is recorded, {used} is used")
    return recorded is not None


def hash_vectors(texts: pd.Series, dimensions: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: signed word hashes, unit length."""
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in (t or "").lower().split():
            h = int(pd.util.hash_array(np.array([w], object), categorize=False)[0])
            v[h % dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def embedded(texts: DataFrame, model: str, dimensions: int = 64, most_chars: int = 500) -> DataFrame:
    """(target_type, target_id, model, dimensions, vector, source_text) for texts (target_type, target_id, text), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            source = pdf["text"].fillna("").str.slice(0, most_chars)
            yield pd.DataFrame({"target_type": pdf["target_type"], "target_id": pdf["target_id"], "model": model, "dimensions": dimensions, "vector": hash_vectors(source, dimensions), "source_text": source})

    return texts.select("target_type", "target_id", "text").mapInPandas(run, "target_type string, target_id string, model string, dimensions int, vector array<float>, source_text string")


def reindexed(g: Graph, model: str, full: bool = False) -> DataFrame:
    """Embeddings for what has none of the model (all of it, if full)."""
    from .search import embedding_gap, entity_text

    texts = g.entities.filter("status = 'active'").select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id"), entity_text().alias("text")).unionByName(g.episodes.filter("status = 'active'").select(F.lit("episode").alias("target_type"), F.col("id").alias("target_id"), F.col("content").alias("text")))
    return embedded(texts if full else texts.join(embedding_gap(g, model), ["target_type", "target_id"], "left_semi"), model)
