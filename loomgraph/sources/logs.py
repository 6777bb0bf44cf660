"""Commit logs: the command that writes one, and reading it as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "---COMMIT-END---"
FORMAT = f"%H%n%ae%n%an%n%at%n%s%n%b%n{END}"
COMMITS = "sha string, author_email string, author_name string, timestamp_unix long, subject string, body string, files array<string>"


def checked_paths(paths: list[str]) -> list[str]:
    """Relative paths that stay inside, without pathspec magic."""
    out = []
    for p in paths:
        if p.startswith(":"):
            raise ValueError(f"pathspec magic is not allowed: {p}")
        if os.path.isabs(p) or ".." in p.split("/"):
            raise ValueError(f"not inside the repository: {p}")
        out.append(os.path.normpath(p))
    return out


def command(repo: str, since: str | None = None, branch: str = "HEAD", cursor: str | None = None, paths: list[str] | None = None) -> list[str]:
    """Run it where the repository is and put its output into a file; executors only ever read that."""
    args = ["git", "-C", repo, "log", f"--format={FORMAT}", "--name-only"]
    if since:
        args.append(f"--since={since}")
    args.append(f"{cursor}..{branch}" if cursor else branch)
    return args + (["--", *checked_paths(paths)] if paths else [])


def parse(text: str) -> list[dict]:
    """One record for each commit: header, body up to the end mark, then file names up to the next commit's hash."""
    out = []
    for head, files in re.findall(rf"(?ms)^([0-9a-fA-F]{{40}}\n.*?)^{END}$\n?(.*?)(?=^[0-9a-fA-F]{{40}}$|\Z)", text):
        lines = head.split("\n")
        if len(lines) < 5:
            continue
        body = "\n".join(lines[5:]).strip()
        out.append({"sha": lines[0], "author_email": lines[1], "author_name": lines[2], "timestamp_unix": int(lines[3] or 0), "subject": lines[4], "body": body, "files": [f for f in files.split("\n") if f.strip()]})
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files, each parsed by one task; write long histories as several files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                rows = parse(text)
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.text(path, wholetext=True).mapInPandas(run, COMMITS)


def touches(commits: DataFrame) -> DataFrame:
    """(commit, author, file, at) for the mining operators."""
    return commits.select(F.col("sha").alias("commit"), F.col("author_email").alias("author"), F.explode("files").alias("file"), F.timestamp_seconds("timestamp_unix").cast("timestamp_ntz").alias("at"))


def episodes(commits: DataFrame) -> DataFrame:
    content = F.concat_ws("\n", F.col("subject"), F.expr("nullif(body, '')"))
    return commits.select(F.lit("git_commit").alias("source_type"), F.lower("sha").alias("source_ref"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.col("author_name").alias("actor"), F.timestamp_seconds("timestamp_unix").cast("timestamp_ntz").alias("timestamp"))
