"""Sources, plugins, moments and streams on small files."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import moments, text
from loomgraph.operators import crossref, digest, mining
from loomgraph.operators.lookup import parse_target
from loomgraph.sources import code, documents, logs, plugins, tables
from loomgraph.streaming import episodes as stream

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)


def test_moments():
    assert moments.resolve("2025-01-02", NOW) == datetime(2025, 1, 2, tzinfo=timezone.utc)
    assert moments.resolve("2025-01-02T03:04:05+02:00", NOW).hour == 1
    assert moments.resolve("yesterday", NOW) == NOW - timedelta(days=1)
    assert moments.resolve("3 weeks ago", NOW) == NOW - timedelta(days=21)
    assert moments.resolve("30d", NOW, short=True) == NOW - timedelta(days=30)
    for bad in ("2026-01-01", "soon", "2025-13-01", "30d"):
        with pytest.raises(moments.InvalidMoment):
            moments.resolve(bad, NOW)


LOG = f"""{'a' * 40}
x@y.z
Xu Y
1700000000
fix: one
body #12
{logs.END}

src/a.py
src/b.py
{'b' * 40}
w@y.z
W
1690000000
two

{logs.END}

src/a.py
"""


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    commits = logs.read_log(spark, str(tmp_path / "log.txt"))
    rows = {r["sha"][0]: r for r in commits.collect()}
    assert rows["a"]["files"] == ["src/a.py", "src/b.py"] and rows["a"]["body"] == "body #12" and rows["b"]["subject"] == "two"
    t = logs.touches(commits)
    assert {(r["file"], r["owner"]) for r in mining.likely_owners(t, "2024-01-01 00:00:00").collect()} == {("src/a.py", "x@y.z"), ("src/b.py", "x@y.z")}
    assert {(r["parent"], r["child"]) for r in mining.module_hierarchy(t.select(F.col("file").alias("path"))).collect()} == {("src", "src/a.py"), ("src", "src/b.py")}
    assert logs.parse("") == [] and "a..HEAD" in logs.command(".", cursor="a")
    for bad in ("/etc", "../x", ":(top)"):
        with pytest.raises(ValueError):
            logs.checked_paths([bad])


def test_source_tree(spark, tmp_path):
    for name, body in {
        "src/a.ts": "import { b } from './b';\nexport class A {}\nexport function go() {}\n",
        "src/b.ts": "export const b = 1;\n",
        "src/node_modules/x.ts": "export const no = 1;\n",
        "src/min.min.js": "x",
        "pkg/BUILD": 'py_library(\n    name = "lib",\n    deps = [":x", "//other:y"],\n)\n',
        "pkg/c.go": "package c\n\n// +kubebuilder:rbac:groups=apps,resources=deployments,verbs=get;list\n// more\ntype Rec struct{}\n\nfunc (r *Rec) SetupWithManager(m M) error {\n\treturn b.For(&v1.Pod{}).Owns(&v1.Job{}).Complete(r)\n}\n",
        "p/m.py": "from os import path\nimport sys\ndef f():\n    pass\nclass G:\n    pass\n",
    }.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "tree/bin.py").write_bytes(b"a\x00b")
    files = code.walk(spark, str(tmp_path / "tree"))
    assert {r["path"] for r in files.collect()} == {"src/a.ts", "src/b.ts", "pkg/BUILD", "pkg/c.go", "p/m.py"}
    found = code.facts(files)
    got = {(r["path"], r["kind"], r["name"]) for r in found.collect()}
    assert {("src/a.ts", "symbol", "A"), ("src/a.ts", "symbol", "go"), ("src/a.ts", "import", "./b"), ("pkg/BUILD", "target", "//pkg:lib"), ("p/m.py", "symbol", "G"), ("pkg/c.go", "symbol", "Rec"), ("pkg/c.go", "grants", "Rec")} <= got
    details = {(r["kind"], r["detail"]) for r in found.collect()}
    assert {("depends", "//pkg:x"), ("depends", "//other:y"), ("grants", "apps/deployments#get"), ("watches", "Pod"), ("owns", "Job")} <= details
    assert [(r["path"], r["target"]) for r in code.import_edges(found, files).collect()] == [("src/a.ts", "src/b.ts")]
    assert code.ignored("a/b/c.log", ["*.log"]) and not code.ignored("keep.log", ["*.log", "!keep.log"]) and code.ignored("x/y", ["/x/"]) and code.language("WORKSPACE.bazel") is None


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "a.md").write_text("# hi")
    md = documents.markdown(spark, str(tmp_path))
    assert md.first()["content"] == "# hi"
    (tmp_path / "d.json").write_text("\n".join(json.dumps(x) for x in [{"number": 5, "html_url": "https://h/o/r/pull/5", "title": "T", "state": "closed", "user": {"login": "u"}, "created_at": "2024-01-01T00:00:00Z", "requested_reviewers": [{"login": "v"}]}, {"number": 6, "html_url": "https://h/o/r/issues/6", "title": None}]))
    dump = documents.forge(spark, str(tmp_path / "d.json"))
    assert {r["source_type"] for r in documents.forge_episodes(dump).collect()} == {"github_pr", "github_issue"}
    assert ("reviewed_by", "v") in {(r["relation"], r["target"]) for r in documents.forge_links(dump).collect()} and ("alias", "o/r#5") in {(r["relation"], r["target"]) for r in documents.forge_links(dump).collect()}
    path = str(tmp_path / "g")
    tables.create(spark, path)
    assert tables.check_version(spark, path) == "0.2.0" and tables.read(spark, path, "edges").count() == 0
    old = spark.createDataFrame([("t", "r", 1)], "a string, b string, v int")
    new = spark.createDataFrame([("t", "r", 2), ("t", "s", 3), ("t", "s", 4), ("t", None, 5), ("t", None, 6)], "a string, b string, v int")
    assert tables.new_rows(old, new, ["a", "b"]).count() == 3
    assert {(r["a"], r["v"]) for r in tables.upsert(old, new.filter("b = 'r'"), ["a", "b"], "v").collect()} == {("t", 2)}
    tables.export_json({"x": spark.createDataFrame([("2",), ("1",)], "id string")}, str(tmp_path / "out"))
    assert [json.loads(r[0])["id"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1", "2"]
    with pytest.raises(tables.EvidenceRequired):
        tables.with_evidence(spark.createDataFrame([("1",)], "id string"), spark.createDataFrame([], "entity_id string"), "id", "entity_id")
    ep = spark.createDataFrame([("e1", "google_doc", "d", "m1", None, "active")], "id string, source_type string, source_ref string, metadata string, superseded_by string, status string")
    inc = spark.createDataFrame([("e2", "google_doc", "d", "m2", None, "active")], ep.schema)
    assert {(r["id"], r["superseded_by"]) for r in tables.supersede_by_ref(ep, inc, "metadata").collect()} == {("e1", "e2"), ("e2", None)}


def test_plugins(spark, tmp_path):
    good = tmp_path / "p" / "one"
    good.mkdir(parents=True)
    (good / "run.py").write_text("")
    m = {"name": "one", "version": "1", "contract_version": 1, "transport": "executable", "entry": "run.py", "capabilities": {}, "vocab_extensions": {"entity_types": ["widget"]}}
    (good / "manifest.json").write_text(json.dumps(m))
    found = plugins.discover([str(tmp_path / "p")])
    assert list(found) == ["one"] and "widget" in plugins.vocabulary({"entity_types": ["file"]}, list(found.values()))["entity_types"]
    with pytest.raises(ValueError):
        plugins.vocabulary({"entity_types": ["widget"]}, list(found.values()))
    (good / "manifest.json").write_text(json.dumps(m | {"entry": "../../x"}))
    with pytest.raises(plugins.ManifestError):
        plugins.manifest(str(good))
    lines = [{"type": "hello_ack", "contract_version": 1}, {"type": "episode", "source_type": "s", "source_ref": "r", "content": "c", "timestamp": "t"}, {"type": "entity", "canonical_name": "a", "entity_type": "file", "episode_ref": "r"}, {"type": "edge", "source_ref": "a", "target_ref": "a", "relation_type": "x", "edge_kind": "observed", "fact": "f", "episode_ref": "r"}, {"type": "edge", "source_ref": "a", "target_ref": "zz", "relation_type": "x", "edge_kind": "observed", "fact": "f", "episode_ref": "r"}, {"type": "done", "cursor": "9"}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, lines)))
    records = plugins.read_lines(spark, str(tmp_path / "o.jsonl"))
    assert plugins.linked(records).count() == 1 and records["done"].first()["cursor"] == "9"
    reg = plugins.Registry()
    reg.add("ok", lambda s, c: s.range(3))
    reg.add("bad", lambda s, c: 1 / 0)
    src = [{"name": "a", "type": "bad"}, {"name": "b", "type": "ok"}]
    assert [r["status"] for r in plugins.sync(spark, src, reg, lambda n, d: d.count(), keep_going=True)] == ["failed", "completed"]
    assert len(plugins.sync(spark, src, reg, lambda n, d: d.count())) == 1
    with pytest.raises(ValueError):
        plugins.sync(spark, [{"name": "a", "type": "ok", "token_env": "NO_SUCH_VARIABLE"}], reg, lambda n, d: 0)


def test_text_and_references(spark):
    df = spark.createDataFrame([("1", "Vector Store café"), ("2", "store of vectors"), ("3", None), ("4", "")], "id string, t string")
    assert {r["id"] for r in text.bm25(df, "id", F.col("t"), text.query_phrases("store")).collect()} == {"1", "2"}
    assert {r["id"] for r in text.bm25(df, "id", F.col("t"), text.query_phrases("vector_store")).collect()} == {"1"}
    assert text.bm25(df, "id", F.col("t"), text.query_phrases("CAFÉ")).count() == 1 and text.bm25(df, "id", F.col("t"), []).count() == 0
    ep = spark.createDataFrame([("e", "see https://github.com/o/r/pull/7 and #12, b/1234567, " + "A" * 40 + " abcdef1")], "id string, content string")
    assert {(r["type"], r["ref"]) for r in crossref.references(ep).collect()} == {("github_pr", "7"), ("github_issue", "#12"), ("buganizer_issue", "b/1234567"), ("git_commit", "a" * 40), ("git_commit", "abcdef1"), ("git_commit", "1234567")}
    with pytest.raises(ValueError):
        crossref.registered([crossref.PATTERNS[0]])
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 3)], "g string, k int, tokens long")
    assert [r["k"] for r in digest.within_budget(rows, 10, ["g"], ["k"]).collect()] == [1]
    assert sorted(r["k"] for r in digest.greedy(rows, 10, "g", ["k"]).collect()) == [1, 3]
    assert parse_target("a/b.py:3")["line"] == 3 and parse_target("Foo")["kind"] == "symbol"


def test_streams(spark, tmp_path):
    schema = tables.SCHEMAS["episodes"]
    row = lambda i, ref: (i, "s", ref, "c", None, None, "active", datetime(2024, 1, 1), datetime(2024, 1, 1), None, "1", None, None)
    spark.createDataFrame([row("1", "a"), row("2", "a"), row("3", None)], schema).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    stream.ingest(stream.read_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([row("4", "a"), row("5", "b")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream.ingest(stream.read_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert spark.read.option("basePath", store).parquet(store).count() == 3
    spark.createDataFrame([("k", 0, 5), ("k", 8, 9), ("k", 4, 6)], "k string, start_us long, end_us long").write.parquet(str(tmp_path / "w"))
    merged = stream.merged_windows(spark.readStream.schema("k string, start_us long, end_us long").parquet(str(tmp_path / "w")), ["k"])
    q = merged.writeStream.format("memory").queryName("merged").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select * from merged").collect()[-1]
    assert (last["n_periods"], last["n_gaps"], last["covered_until"]) == (2, 1, 9)
    d = stream.deduplicated(stream.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.sql("select * from once").count() == 3
