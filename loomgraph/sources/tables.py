"""Graph folders: schemas, opening with a version gate, upserts, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION, READABLE = "0.2.0", ("0.1.0", "0.2.0")

# The stored tables.
SCHEMAS = {
    "metadata": "key string, value string",
    "entities": "id string, canonical_name string, entity_type string, summary string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, owner_id string",
    "entity_aliases": "id string, entity_id string, alias string, valid_from timestamp_ntz, valid_until timestamp_ntz, episode_id string, created_at timestamp_ntz",
    "edges": "id string, source_id string, target_id string, relation_type string, edge_kind string, fact string, weight double, valid_from timestamp_ntz, valid_until timestamp_ntz, created_at timestamp_ntz, invalidated_at timestamp_ntz, superseded_by string, confidence double, owner_id string",
    "episodes": "id string, source_type string, source_ref string, content string, content_hash string, actor string, status string, timestamp timestamp_ntz, ingested_at timestamp_ntz, owner_id string, extractor_version string, metadata string, superseded_by string",
    "entity_evidence": "entity_id string, episode_id string, extractor string, confidence double, created_at timestamp_ntz",
    "edge_evidence": "edge_id string, episode_id string, extractor string, confidence double, created_at timestamp_ntz",
    "ingestion_runs": "id string, source_type string, source_scope string, started_at timestamp_ntz, completed_at timestamp_ntz, cursor string, extractor_version string, episodes_created int, entities_created int, edges_created int, status string, error string",
    "stored_embeddings": "id string, target_type string, target_id string, model string, dimensions int, vector array<float>, source_text string, created_at timestamp_ntz",
    "projections": "id string, kind string, anchor_type string, anchor_id string, title string, body string, body_format string, model string, input_fingerprint string, confidence double, valid_from timestamp_ntz, valid_until timestamp_ntz, invalidated_at timestamp_ntz, superseded_by string, created_at timestamp_ntz, owner_id string",
    "projection_evidence": "projection_id string, target_type string, target_id string, role string, content_hash string",
    "reconciliation_runs": "id string, started_at timestamp_ntz, completed_at timestamp_ntz, scope string, phases string, dry_run boolean, status string, error string",
    "unresolved_refs": "id string, source_episode_id string, target_source_type string, target_ref string, detected_at timestamp_ntz, resolved_at timestamp_ntz",
}


class FormatError(ValueError):
    pass


class EvidenceRequired(ValueError):
    pass


def key_id(*parts: str):
    """Ids that follow from what a row stands for, so that a replay gives the same row."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def create(spark: SparkSession, path: str) -> None:
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame([("format_version", VERSION)], schema) if name == "metadata" else spark.createDataFrame([], schema)
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")


def check_version(spark: SparkSession, path: str) -> str:
    rows = spark.read.schema(SCHEMAS["metadata"]).parquet(f"{path}/metadata.parquet").filter("key = 'format_version'").limit(1).collect()
    version = rows[0]["value"] if rows else ""
    if not READABLE[0] <= version <= READABLE[1]:
        raise FormatError(f"not readable: version {version!r}")
    return version


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """With the stored schema, so that older folders that lack newer columns read as nulls."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one for each key; a row with a null key part is always new."""
    known = existing.select(*keys).distinct()
    null_key = " or ".join(f"`{k}` is null" for k in keys)
    keyed = incoming.filter(f"not ({null_key})").dropDuplicates(keys).join(known, keys, "left_anti")
    return keyed.unionByName(incoming.filter(null_key).select(*keyed.columns))


def with_evidence(items: DataFrame, evidence: DataFrame, id: str, key: str) -> DataFrame:
    """The items, after a check that each has evidence."""
    bare = items.join(evidence.select(F.col(key).alias(id)), id, "left_anti").select(id).limit(3).collect()
    if bare:
        raise EvidenceRequired(f"without evidence: {[r[0] for r in bare]}")
    return items


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both, the row of greatest order winning for each key."""
    both = existing.unionByName(incoming)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def supersede_by_ref(existing: DataFrame, incoming: DataFrame, changed: str) -> DataFrame:
    """Episodes after incoming ones replaced the current ones of the same reference whose `changed` column differs; equal ones are left out."""
    current = existing.filter("superseded_by is null and source_ref is not null").select("source_type", "source_ref", F.col("id").alias("old_id"), F.col(changed).alias("old_value"))
    joined = incoming.join(current, ["source_type", "source_ref"], "left")
    fresh = joined.filter(F.col("old_id").isNull() | ~F.col(changed).eqNullSafe(F.col("old_value")))
    link = fresh.filter("old_id is not null").groupBy("old_id").agg(F.min("id").alias("by"))
    old = existing.join(link, existing["id"] == link["old_id"], "left").withColumn("superseded_by", F.coalesce("by", "superseded_by")).withColumn("status", F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")))
    return old.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def json_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(value): one JSON object a row with its type; ordered by type and id when written by `export_json`."""
    out = None
    for name, df in tables.items():
        row = df.select(F.lit(name).alias("k"), "id", F.to_json(F.struct(F.lit(name).alias("type"), *df.columns)).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    json_lines(tables).orderBy("k", "id").select("value").write.mode("overwrite").text(path)


def export_markdown(entities: DataFrame, path: str) -> None:
    line = F.concat(F.lit("- **"), "canonical_name", F.lit("** ("), "entity_type", F.lit(") "), F.coalesce("summary", F.lit("")))
    entities.orderBy("id").select(line.alias("value")).write.mode("overwrite").text(path)


def export_pages(pages: DataFrame, path: str) -> None:
    """One folder for each page (kind, slug, title, body), each holding its text, plus an index."""
    pages.select("slug", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("value")).write.mode("overwrite").partitionBy("slug").text(f"{path}/pages")
    pages.select(F.concat(F.lit("- ["), "title", F.lit("](pages/slug="), "slug", F.lit(")")).alias("value")).orderBy("value").write.mode("overwrite").text(f"{path}/index")
