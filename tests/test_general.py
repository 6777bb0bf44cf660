"""The general operators against brute force, with hot keys, nulls, ties, repeats, empty tables and clashing column names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.asof import as_known
from loomgraph.operators.hierarchy import hierarchy, paths, walk_down
from loomgraph.operators.intervals import IntervalMap, coverage
from loomgraph.operators.orphans import ForeignKey, Table, orphans
from loomgraph.operators.skew import running_count, salted_join


def brute_periods(windows):
    out = []
    for s, e in sorted((float("-inf") if s is None else s, float("inf") if e is None else e) for s, e in windows):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(None if s == float("-inf") else s, None if e == float("inf") else e) for s, e in out]


def test_interval_map_in_any_order():
    for seed in range(200):
        r = random.Random(seed)
        windows = [(a := r.randint(0, 40), a + r.randint(-2, 8)) for _ in range(r.randint(0, 12))]
        m = IntervalMap()
        for w in windows:
            m.add(*w)
        assert m.periods() == brute_periods(windows)
        assert m.gaps() == [(a[1], b[0]) for a, b in zip(m.periods(), m.periods()[1:])]


@pytest.mark.parametrize("hot", [3, 10_000])
def test_coverage_equals_brute_force(spark, hot):
    r = random.Random(5)
    rows = []
    for _ in range(400):
        k = r.choice(["hot", "hot", "a", "b", None, ""])
        s = r.choice([None, *[r.randint(0, 900)] * 12])
        e = None if r.random() < 0.01 else (s or 0) + r.randint(-3, 12)
        rows.append((k, s, e, 1))
    rows = [x for x in rows if x[0] != "hot" or (x[1] is not None and x[2] is not None)] + [("one", 1, 2, 1)] + rows[:20]
    df = spark.createDataFrame(rows, "k string, s long, e long, kind int")
    got = {}
    for x in coverage(df, ["k"], "s", "e", hot_rows=hot, slices=4).collect():
        got.setdefault((x["k"], x["kind"]), []).append((x["from_us"], x["until_us"]))
    for k in {x[0] for x in rows}:
        want = brute_periods([(s, e) for kk, s, e, _ in rows if kk == k])
        key = lambda p: (p[0] is not None, p[0] or 0)
        assert sorted(got.get((k, "period"), []), key=key) == want
        assert sorted(got.get((k, "gap"), [])) == [(a[1], b[0]) for a, b in zip(want, want[1:])]
    only = {(x["k"], x["from_us"]) for x in coverage(df, ["k"], "s", "e", gaps_only=True, hot_rows=hot, slices=4).filter("kind = 'gap'").collect()}
    assert only == {(k, s) for (k, kind), v in got.items() if kind == "gap" for s, _ in v}
    assert coverage(df.limit(0), ["k"], "s", "e").count() == 0


def test_orphans_direct_and_inherited(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    ts = "cast({} as timestamp_ntz)"
    edges = spark.createDataFrame(
        [("E1", " n1 ", "N2", "", t(5)), ("E2", "GONE", "N1", "e1", t(5)), ("E3", "N1", None, "E2", t(5)), ("E4", "N1", "N3", "E3", t(5)), ("E5", "N1", "N1", "NONE", t(5)), ("E6", "N1", "N1", "E7", t(5)), ("E7", "N1", "N1", "E6", t(5)), ("E8", "N1", "N1", "E5", t(5)), (None, "X", "Y", "Z", t(5)), ("E1", " n1 ", "N2", "", t(5))],
        "id string, source_id string, target_id string, superseded_by string, c string",
    ).withColumn("created_at", F.expr(ts.format("c"))).withColumn("gone", F.lit(1)).withColumn("level", F.lit("x"))
    nodes = spark.createDataFrame([("N1", t(1)), ("n2", t(9)), ("N3", t(2)), ("N3", t(2))], "id string, c string").withColumn("created_at", F.expr(ts.format("c")))
    keys = [ForeignKey("edges", "source_id", "nodes"), ForeignKey("edges", "target_id", "nodes"), ForeignKey("edges", "superseded_by", "edges", late=False)]
    for hot in (1, 1000):
        rows = {(r["ref_column"], r["row_id"], r["ref_state"], r["level"]) for r in orphans({"edges": Table(edges), "nodes": Table(nodes)}, keys, hot_rows=hot).collect()}
        assert rows == {("target_id", "E1", "late", 0), ("source_id", "E2", "missing", 0), ("superseded_by", "E5", "missing", 0), ("superseded_by", "E3", "inherited", 1), ("superseded_by", "E8", "inherited", 1), ("superseded_by", "E4", "inherited", 2)}
    assert orphans({"edges": Table(edges.limit(0)), "nodes": Table(nodes.limit(0))}, keys).count() == 0


def test_cascade_by_doubling_and_by_rounds(spark):
    """A chain of seventy below an orphan, loops with and without one, and a table whose rows refer to two others."""
    made = "cast('2024-01-01 00:00:00' as timestamp_ntz)"
    rows = [("C0", "NONE")] + [(f"C{i}", f"C{i - 1}") for i in range(1, 71)] + [("L1", "L2"), ("L2", "L3"), ("L3", "L1"), ("B1", "L1"), ("R1", None), ("R2", "R1")]
    nodes = spark.createDataFrame(rows, "id string, up string").withColumn("created_at", F.expr(made))
    leaves = spark.createDataFrame([("X", "C70"), ("Y", "R2"), ("Z", "C0")], "id string, node string").withColumn("created_at", F.expr(made))
    keys = [ForeignKey("nodes", "up", "nodes", late=False), ForeignKey("leaves", "node", "nodes", late=False)]
    tables = {"nodes": Table(nodes), "leaves": Table(leaves)}
    got = {(r["row_id"], r["level"]) for r in orphans(tables, keys).collect()}
    assert got == {("C0", 0)} | {(f"C{i}", i) for i in range(1, 71)} | {("X", 71), ("Z", 1)}
    # two references a row: level by level
    double = nodes.withColumn("second", F.when(F.col("id") == "C5", F.lit("R1")))
    twice = [*keys, ForeignKey("nodes", "second", "nodes", late=False)]
    assert {(r["row_id"], r["level"]) for r in orphans({"nodes": Table(double.filter("id not like 'C__'")), "leaves": Table(leaves)}, twice).collect()} >= {("C0", 0), ("C9", 9), ("X", 0), ("Z", 1)}
    assert max(r["level"] for r in orphans(tables, keys, max_levels=3).collect()) == 3


def brute_walk(parent, node):
    seen, path = set(), [node]
    while parent.get(path[-1]) in parent or parent.get(path[-1]) in set(parent) | {p for p in parent.values()}:
        nxt = parent[path[-1]]
        if nxt in seen or nxt == node:
            loop = [nxt]
            while parent[loop[-1]] != nxt:
                loop.append(parent[loop[-1]])
            return min(loop), -1, None
        seen.add(nxt)
        path.append(nxt)
        if nxt not in parent:
            break
    return path[-1], len(path) - 1, path[::-1]


@pytest.mark.parametrize("seed,hot", [(1, 2), (2, 10_000), (3, 10_000)])
def test_hierarchy_equals_walking(spark, seed, hot):
    r = random.Random(seed)
    ids = [f"N{i:03d}" for i in range(90)]
    parent = {}
    for i, n in enumerate(ids):
        x = r.random()
        if x < 0.25 and i:
            parent[n] = ids[i - 1]
        elif x < 0.75:
            parent[n] = r.choice([ids[0], r.choice(ids)])
        elif x < 0.8:
            parent[n] = "ABSENT"
    parent = {k: v for k, v in parent.items()}
    rows = [(n, r.choice([parent.get(n), (parent.get(n) or "").lower(), f" {parent[n]}" if n in parent else None]), 7) for n in ids]
    rows = [(n, p if n in parent else r.choice([None, "", " "]), c) for n, p, c in rows]
    df = spark.createDataFrame([*rows, *rows[:9], (None, "N001", 1)], "id string, up string, depth int")
    known = {n: p for n, p in parent.items() if p in ids}
    tree = hierarchy(df, "id", "up", hot)
    got = {x["id"]: (x["root_id"], x["depth"]) for x in tree.nodes.collect()} | {x["id"]: (x["root_id"], -1) for x in tree.loops.collect()}
    want = {n: brute_walk(known, n)[:2] for n in parent}
    assert {n: got[n] for n in parent} == want
    full = {x["id"]: (x["path"], x["n_descendants"]) for x in paths(tree).collect()}
    walks = {n: brute_walk(known, n)[2] for n in ids}
    for n in full:
        assert full[n][0] == walks[n]
        assert full[n][1] == sum(w is not None and n in w[:-1] for w in walks.values())
    below = {(x["ancestor"], x["descendant"]) for x in walk_down(tree, df.select("id")).collect()}
    assert below == {(a, n) for n, w in walks.items() if w and n in full for a in w[:-1]}
    assert hierarchy(df.limit(0), "id", "up").nodes.count() == 0


@pytest.mark.parametrize("hot", [3, 10_000])
def test_as_known_equals_brute_force(spark, hot):
    r = random.Random(9)
    day = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    facts = [(r.choice("aaab"), f"F{i:02d}", a := r.randint(0, 99), r.choice([None, a + r.randint(-1, 40)])) for i in range(60)]
    events = [(r.choice(["a", "a", "b", "c", None]), i, r.randint(0, 110)) for i in range(150)]
    fdf = spark.createDataFrame([(e, f, day(a), None if b is None else day(b), "x") for e, f, a, b in [*facts, *facts[:5]]] + [(None, "Z", day(1), None, "x"), ("a", None, day(1), None, "x")], "e string, id string, a string, b string, _v string").withColumns({"a": F.expr("cast(a as timestamp_ntz)"), "b": F.expr("cast(b as timestamp_ntz)")})
    edf = spark.createDataFrame([(e, i, day(t)) for e, i, t in events] + [("a", 999, None)], "e string, i int, t string").withColumn("t", F.expr("cast(t as timestamp_ntz)"))
    got = {x["i"]: x["_fact"] for x in as_known(edf, fdf, "e", "t", "e", "id", "a", "b", hot).collect()}
    want = {}
    for e, i, t in events:
        live = [(a, f) for fe, f, a, b in facts if fe == e and a <= t and (b is None or b > t)]
        if live:
            want[i] = max(live)[1]
    assert got == want
    assert as_known(edf.limit(0), fdf, "e", "t", "e", "id", "a", "b").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i % 7}", i) for i in range(100)] + [(None, -1)], "k string, v int")
    right = spark.createDataFrame([("h", 1), ("k0", 2), ("zz", 3)], "rk string, w int")
    want = sorted(map(str, (lambda d: d if how in ("left_semi", "left_anti") else d.drop("rk"))(left.join(right, left["k"] == right["rk"], how)).collect()))
    assert sorted(map(str, salted_join(left, right, "k", "rk", how, hot_rows=5, salts=4).collect())) == want


def test_running_count_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [(r.choice("hhhx"), r.randint(0, 30), i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, t int, one int")
    for hot in (20, 1000):
        got = {x["t"]: x["n"] for x in running_count(df, "k", "o", "t", "one", "n", hot, 5).collect()}
        for k in "hx":
            assert [got[t] for _, o, t, _ in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))] == list(range(1, 1 + sum(x[0] == k for x in rows)))


def test_replaced_edges_come_out_in_and_below_loops(spark, tmp_path):
    from loomgraph.plans import general

    rows = [("a", "B "), ("b", "c"), ("c", None), ("d", "c"), ("x", "y"), ("y", "x"), ("t", "x"), ("u", "t"), ("s", "s"), ("e", "gone"), ("a", "B ")]
    spark.createDataFrame(rows, "id string, superseded_by string").write.parquet(f"{tmp_path}/edges.parquet")
    got = sorted((r["edge_id"], r["replaced_id"]) for r in general.p6_descendants(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(x) for x in "BA CA CB CD XY YX XT YT XU YU TU".split())


def test_shortest_paths_of_eight_steps_are_registered(spark, data, tmp_path):
    import duckdb

    from loomgraph.plans import retrieval

    for f in os.listdir(data):
        if f.split(".")[0] not in ("entities", "edges"):
            os.symlink(f"{data}/{f}", f"{tmp_path}/{f}")
    c = duckdb.connect()
    c.execute(f"create table n as select * from '{data}/entities.parquet'; create table e as select * from '{data}/edges.parquet'")
    goal = "00GOAL"
    c.execute("insert into n select * replace ('ZCHAIN0' as id) from n where entity_type = 'service' limit 1")
    c.execute(f"insert into n select * replace ('{goal}' as id, 'k8s_resource_kind' as entity_type) from n limit 1")
    ends = [f"ZCHAIN{i}" for i in range(8)] + [goal]
    for i in range(8):
        c.execute(f"insert into e select * replace ('ZEDGE{i}' as id, '{ends[i]}' as source_id, '{ends[i + 1]}' as target_id, null as invalidated_at) from e limit 1")
    c.execute(f"copy n to '{tmp_path}/entities.parquet'; copy e to '{tmp_path}/edges.parquet'")
    got = retrieval.QUERIES["G3_shortest_path"](spark, str(tmp_path)).filter("start = 'ZCHAIN0'").collect()
    assert [(r["goal"], r["length"]) for r in got] == [(goal, 8)]


def test_shortest_paths_hold_no_rows_for_each_start_and_record(spark, monkeypatch):
    """300 records, 60 starts, two goals: paths equal brute force, and what is written does not grow with starts x records."""
    from types import SimpleNamespace

    from loomgraph.operators import traverse

    r = random.Random(3)
    links = [(f"n{i:03d}", f"n{r.randrange(max(1, i - 12), i + 1):03d}") for i in range(1, 300)] + [(f"n{r.randrange(300):03d}", f"n{r.randrange(300):03d}") for _ in range(60)]
    e = spark.createDataFrame([(f"e{i}", a, b, "x", "observed", 1.0) for i, (a, b) in enumerate([*links, ("n000", None), (None, "n001")])], "id string, source_id string, target_id string, relation_type string, edge_kind string, confidence double")
    edges = e.withColumn("invalidated_at", F.lit(None).cast("timestamp_ntz"))
    starts, goals = [f"n{i:03d}" for i in range(0, 300, 5)] + ["alone"], ["n000", "n299"]
    steps = {}
    for a, b in links:
        steps.setdefault(a, set()).add(b)
        steps.setdefault(b, set()).add(a)
    want = {}
    for s in starts:
        best, ring = {s: [s]}, {s: [s]}
        for _ in range(6):
            ring = {t: p for t, p in sorted(((t, [*p, t]) for i, p in ring.items() for t in steps.get(i, ())), key=lambda x: x[1], reverse=True) if t not in best}
            best |= ring
        want |= {(s, g): best[g] for g in goals if g in best}
    rows = []

    class Counted(traverse.Cut):
        def __init__(self, *a, **k):
            super().__init__(*a, **k)
            rows.append(self.df.count())

    monkeypatch.setattr(traverse, "Cut", Counted)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
    got = traverse.shortest_paths(SimpleNamespace(edges=edges), ids(starts), ids(goals), 6).collect()
    assert {(x["start"], x["goal"]): x["path"] for x in got} == want and len(got) == len(want)
    assert all(x["length"] == len(x["path"]) - 1 for x in got)
    assert sum(rows) < 4000
