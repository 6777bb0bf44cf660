"""What a commit log tells: authorship, co-change, likely owners and who took over."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import at, days_between

HALF_LIFE = 90


def authored(touches: DataFrame) -> DataFrame:
    """(file, author, commit): the newest commit of each author on each file; touches: (commit, author, file, at)."""
    newest = touches.groupBy("file", "author").agg(F.max(F.struct("at", "commit")).alias("m"))
    return newest.select("file", "author", F.col("m.commit").alias("commit"))


def co_changes(touches: DataFrame, least: int = 3, confidence: float = 0.8) -> DataFrame:
    """(file_a < file_b, n, weight, confidence, commit): files that changed together in at least `least` commits.

    Commits with one file are left out before the self-join, which is on the commit; pair counts are combined before the shuffle.
    The evidence is the newest shared commit.
    """
    once = touches.select("commit", "file", "at").dropDuplicates(["commit", "file"])
    several = once.groupBy("commit").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("commit")
    rows = once.join(several, "commit", "left_semi")
    a = rows.select("commit", "at", F.col("file").alias("file_a"))
    b = rows.select("commit", F.col("file").alias("file_b"))
    pairs = a.join(b, "commit").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "commit")).alias("m"))
    return pairs.filter(F.col("n") >= least).select("file_a", "file_b", "n", F.least(F.col("n") / 10, F.lit(1.0)).alias("weight"), F.lit(confidence).alias("confidence"), F.col("m.commit").alias("commit"))


def owner_scores(touches: DataFrame, now: str) -> DataFrame:
    """(file, author, score): halved every 90 days; shares are rounded, so that sums are the same in any order."""
    age = F.greatest(F.lit(0.0), days_between(at(now), F.col("at")))
    share = F.round(F.exp(-age * math.log(2) / HALF_LIFE), 9)
    return touches.dropDuplicates(["commit", "file"]).groupBy("file", "author").agg(F.round(F.sum(share), 6).alias("score"))


def likely_owners(touches: DataFrame, now: str) -> DataFrame:
    """(file, owner, score, confidence)."""
    w = Window.partitionBy("file").orderBy(F.desc("score"), "author")
    top = owner_scores(touches, now).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return top.select("file", F.col("author").alias("owner"), "score", F.least(F.col("score"), F.lit(1.0)).alias("confidence"))


def owner_changes(touches: DataFrame, before: str, now: str) -> DataFrame:
    """(file, owner_before, owner_after): files whose likely owner is another than it was when only the earlier commits were known."""
    old = likely_owners(touches.filter(F.col("at") <= at(before)), before).select("file", F.col("owner").alias("owner_before"))
    new = likely_owners(touches, now).select("file", F.col("owner").alias("owner_after"))
    return old.join(new, "file").filter("owner_before <> owner_after")


def introducing(touches: DataFrame) -> DataFrame:
    """(file, commit): the oldest commit that touched a file."""
    return touches.groupBy("file").agg(F.min(F.struct("at", "commit")).alias("m")).select("file", F.col("m.commit").alias("commit"))


def module_hierarchy(paths: DataFrame) -> DataFrame:
    """(parent, child): every folder above a path, each contained in the one above it, and the path in the lowest."""
    parts = F.split("path", "/")
    rows = paths.select("path", parts.alias("p")).filter("size(p) > 1")
    steps = rows.select(F.explode(F.expr("transform(sequence(1, size(p) - 1), i -> named_struct('parent', array_join(slice(p, 1, i), '/'), 'child', array_join(slice(p, 1, i + 1), '/')))")).alias("s"))
    return steps.select("s.parent", "s.child").distinct()
