"""Plugins: manifests, where they are found, the vocabulary they add, and the JSON lines they write."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = 1
# The fields of a line, by its type.
LINES = {
    "hello_ack": "contract_version int",
    "episode": "source_type string, source_ref string, content string, actor string, timestamp string, metadata map<string, string>",
    "entity": "canonical_name string, entity_type string, summary string, episode_ref string",
    "edge": "source_ref string, target_ref string, relation_type string, edge_kind string, fact string, episode_ref string",
    "progress": "phase string, fetched int, created int, skipped int",
    "error": "message string",
    "done": "cursor string",
}


class ManifestError(ValueError):
    pass


@dataclass
class Manifest:
    name: str
    version: str
    transport: str
    entry: str
    folder: str
    vocabulary: dict = field(default_factory=dict)


def manifest(folder: str) -> Manifest:
    """Read and checked: required fields, contract version, transport, and an entry that stays in the folder."""
    try:
        with open(os.path.join(folder, "manifest.json")) as f:
            m = json.load(f)
    except (OSError, ValueError) as e:
        raise ManifestError(f"{folder}: {e}") from e
    missing = [k for k in ("name", "version", "contract_version", "transport", "entry", "capabilities") if k not in m]
    if missing:
        raise ManifestError(f"{folder}: missing {missing}")
    if not isinstance(m["contract_version"], (int, float)) or int(m["contract_version"]) != CONTRACT:
        raise ManifestError(f"{folder}: contract version {m['contract_version']}")
    if m["transport"] not in ("executable", "module"):
        raise ManifestError(f"{folder}: transport {m['transport']}")
    inside = os.path.realpath(os.path.join(folder, m["entry"]))
    if not inside.startswith(os.path.realpath(folder) + os.sep):
        raise ManifestError(f"{folder}: entry leaves the folder")
    return Manifest(m["name"], m["version"], m["transport"], inside, folder, m.get("vocab_extensions", {}))


def discover(folders: list[str]) -> dict[str, Manifest]:
    """Plugins by name, folders of higher precedence first; broken ones are left out."""
    out: dict[str, Manifest] = {}
    for root in folders:
        for name in sorted(os.listdir(root)) if os.path.isdir(root) else []:
            try:
                m = manifest(os.path.join(root, name))
            except ManifestError:
                continue
            out.setdefault(m.name, m)
    return out


def vocabulary(base: dict[str, list[str]], plugins: list[Manifest]) -> dict[str, list[str]]:
    """The base words and those of plugins; a word two sides claim is an error."""
    out = {k: list(v) for k, v in base.items()}
    for p in plugins:
        for kind, words in p.vocabulary.items():
            for w in words:
                if w in out.setdefault(kind, []):
                    raise ValueError(f"{p.name}: {kind} {w} exists already")
                out[kind].append(w)
    return out


def read_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The records of plugin output by type; a file without a done line, or with an error line, is no complete run."""
    raw = spark.read.text(path).withColumn("type", F.get_json_object("value", "$.type"))
    return {t: raw.filter(F.col("type") == t).select(F.from_json("value", schema).alias("r")).select("r.*") for t, schema in LINES.items()}


def linked(records: dict[str, DataFrame]) -> DataFrame:
    """(source, target, relation_type, edge_kind, fact): edges whose ends and episode are all in the output; others are dropped as dangling."""
    e = records["entity"].select(F.col("canonical_name").alias("name")).distinct()
    p = records["episode"].select(F.col("source_ref").alias("episode_ref")).distinct()
    d = records["edge"].join(p, "episode_ref", "left_semi")
    d = d.join(e, d["source_ref"] == e["name"], "left_semi")
    return d.join(e, d["target_ref"] == e["name"], "left_semi").select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), "relation_type", "edge_kind", "fact")


class Registry:
    """Adapters of this process: a name and a function (spark, config) -> DataFrame of episodes."""

    def __init__(self) -> None:
        self.adapters: dict[str, Callable] = {}

    def add(self, name: str, f: Callable) -> None:
        if name in self.adapters:
            raise ValueError(f"exists already: {name}")
        self.adapters[name] = f


def sync(spark: SparkSession, sources: list[dict], registry: Registry, take: Callable[[str, DataFrame], int], only: str | None = None, keep_going: bool = False) -> list[dict]:
    """Runs the sources in the order given. Environment variables they need are looked for before anything starts."""
    chosen = [s for s in sources if only is None or s["name"] == only]
    if only is not None and not chosen:
        raise ValueError(f"no such source: {only}")
    for s in chosen:
        if s["type"] not in registry.adapters:
            raise ValueError(f"{s['name']}: unknown type {s['type']}")
        if (env := s.get("token_env")) and not os.environ.get(env):
            raise ValueError(f"{s['name']}: {env} is not set")
    out = []
    for s in chosen:
        try:
            n = take(s["name"], registry.adapters[s["type"]](spark, s))
            out.append({"name": s["name"], "status": "completed", "episodes": n})
        except Exception as e:
            out.append({"name": s["name"], "status": "failed", "error": str(e)})
            if not keep_going:
                break
    return out
