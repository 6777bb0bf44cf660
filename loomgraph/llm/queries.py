"""The queries of this subpackage, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import contamination, dedup_history, names, neighbours, packing, pii


#: Batches the ingestion runs are fed in, each of consecutive whole runs: a batch costs some forty small jobs however few rows it has.
RUN_BATCHES = 4


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    at = [i / RUN_BATCHES for i in range(1, RUN_BATCHES)]
    starts = load(spark, d, "ingestion_runs").agg(F.percentile_approx(started, at, 10_000)).first()[0] or []
    found = dedup_history.deduplicate(load(spark, d, "episodes"), "id", "content", "ingested_at", bounds=[x - 1 for x in starts])
    return found.select(F.least("id", "accepted_id").alias("episode_a"), F.greatest("id", "accepted_id").alias("episode_b"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "entities").filter("entity_type = 'person'").select("id", F.col("canonical_name").alias("name"))
    return names.link_people(people, load(spark, d, "entity_aliases").select("entity_id", "alias"), load(spark, d, "episodes").select("actor"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(load(spark, d, "stored_embeddings")).select("id", "neighbour", "cosine", "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(load(spark, d, "stored_embeddings"), k=10, least=0.9)
    return near.select(F.least("id", "neighbour").alias("vector_a"), F.greatest("id", "neighbour").alias("vector_b")).distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    # a handful of named capacities, all of them
    budgets = [(r[0], r[1]) for r in load(spark, d, "context_budgets").select("budget_name", "capacity_tokens").distinct().orderBy("budget_name").collect()]
    return packing.pack_documents(load(spark, d, "documents"), budgets)


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_spans(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "item_id").distinct()


def p9_removal(spark: SparkSession, d: str) -> DataFrame:
    return contamination.removal_spans(p9_spans(spark, d))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(load(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_spans(spark, d).select("doc_id", "pii_type", "pii_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(load(spark, d, "documents"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p9_removal": p9_removal, "p10_found": p10_found, "p10_spans": p10_spans, "p10_redacted": p10_redacted, "p8_packed": p8_packed, "p9_found": p9_found, "p9_spans": p9_spans}
SQL: dict[str, str] = {}
#: Every passage's n-word phrases against every document's, as word lists.
SQL["p9_found"] = """
with dw as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents where text is not null),
iw as (select item_id, list_filter(string_split_regex(lower(passage), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from eval_items),
dp as (select distinct doc_id, array_to_string(w[i:i + 9], ' ') p from (select doc_id, w, unnest(range(1, len(w) - 8)) i from dw where len(w) >= 10)),
ip as (select distinct item_id, array_to_string(w[i:i + 9], ' ') p from (select item_id, w, unnest(range(1, len(w) - 8)) i from iw where len(w) >= 10))
select distinct doc_id, item_id from dp join ip using (p)"""
