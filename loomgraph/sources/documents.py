"""Markdown files, pasted text, and dumps of forges and document stores, as episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE = "source_type string, source_ref string, content string, content_hash string, actor string, timestamp timestamp_ntz"
PERSON = "struct<login: string>"
PULL = f"number int, html_url string, title string, body string, state string, user {PERSON}, created_at string, updated_at string, requested_reviewers array<{PERSON}>, assignees array<{PERSON}>, pull_request string"


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2("content", 256)).select(*[c.split()[0] for c in EPISODE.split(", ")])


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """One document episode for each file (folder or glob), referred to by its path, dated by its last change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return hashed(files.select(F.lit("document").alias("source_type"), F.regexp_replace("path", "^file:/*", "/").alias("source_ref"), F.decode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("actor"), F.col("modificationTime").cast("timestamp_ntz").alias("timestamp")))


def pasted(spark: SparkSession, content: str, at: str, source_ref: str | None = None, actor: str | None = None) -> DataFrame:
    row = spark.createDataFrame([("manual", source_ref, content, actor, at)], "source_type string, source_ref string, content string, actor string, t string")
    return hashed(row.withColumn("timestamp", F.col("t").cast("timestamp_ntz")))


def forge(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests and issues of a JSON dump, one record a line."""
    return spark.read.schema(PULL).json(path)


def forge_episodes(dump: DataFrame) -> DataFrame:
    """Issues that are pull requests in disguise are left out; late-closed ones are kept, as the key, not a cursor, tells what is new."""
    pull = F.col("html_url").contains("/pull/")
    head = F.concat(F.when(pull, "PR #").otherwise("Issue #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")))
    who = F.coalesce("user.login", F.lit("unknown"))
    content = F.trim(F.concat_ws("\n", head, F.concat(F.lit("URL: "), "html_url"), F.concat(F.lit("State: "), "state"), F.concat(F.lit("Author: "), who), F.concat(F.lit("Created: "), "created_at"), F.lit(""), F.coalesce("body", F.lit(""))))
    rows = dump.filter(pull | F.col("pull_request").isNull())
    return hashed(rows.select(F.when(pull, "github_pr").otherwise("github_issue").alias("source_type"), F.col("html_url").alias("source_ref"), content.alias("content"), F.col("user.login").alias("actor"), F.to_timestamp("created_at").cast("timestamp_ntz").alias("timestamp")))


def forge_links(dump: DataFrame) -> DataFrame:
    """(source, relation, target): authors, reviewers, and the short names of each record."""
    by = dump.filter("user.login is not null").select(F.col("html_url").alias("source"), F.lit("authored_by").alias("relation"), F.col("user.login").alias("target"))
    reviewed = dump.select(F.col("html_url").alias("source"), F.lit("reviewed_by").alias("relation"), F.explode("requested_reviewers.login").alias("target"))
    repo = F.regexp_extract("html_url", r"^https?://[^/]+/([^/]+/[^/]+)/", 1)
    number = F.concat(F.lit("#"), F.col("number").cast("string"))
    alias = dump.select(F.col("html_url").alias("source"), F.lit("alias").alias("relation"), F.explode(F.array(number, F.concat(repo, number))).alias("target"))
    return by.unionByName(reviewed).unionByName(alias)


def changes(dump: DataFrame) -> DataFrame:
    """Episodes of a review system's dump (number, project, subject, owner, created, message)."""
    content = F.concat_ws("\n", F.concat(F.lit("Change "), F.col("number").cast("string"), F.lit(": "), "subject"), "message")
    return hashed(dump.select(F.lit("gerrit_change").alias("source_type"), F.col("number").cast("string").alias("source_ref"), content.alias("content"), F.col("owner").alias("actor"), F.to_timestamp("created").cast("timestamp_ntz").alias("timestamp")))


def revisions(dump: DataFrame) -> DataFrame:
    """Episodes of a document store's dump (id, revision, title, text, editor, modified); the revision goes into metadata, and
    `tables.supersede_by_ref(existing, these, "metadata")` replaces what has a new one. The next cursor is max(modified)."""
    rows = dump.select(F.lit("google_doc").alias("source_type"), F.col("id").alias("source_ref"), F.concat_ws("\n", "title", "text").alias("content"), F.col("editor").alias("actor"), F.to_timestamp("modified").cast("timestamp_ntz").alias("timestamp"), F.to_json(F.struct(F.col("revision").alias("revisionId"))).alias("metadata"))
    return rows.withColumn("content_hash", F.sha2("content", 256))
