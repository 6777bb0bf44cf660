import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import pages, projections
from loomgraph.sources.tables import SCHEMAS


def test_life_of_a_page(spark, data):
    g = Graph(spark, data)
    none = spark.createDataFrame([], SCHEMAS["projections"])
    bare = spark.createDataFrame([], SCHEMAS["projection_evidence"])
    entity = g.entities.filter("status = 'active'").orderBy("id").first()["id"]
    draft = lambda i: spark.createDataFrame([(i, "entity_summary", "entity", entity, "T", "body of words", "m", 1.0)], "id string, kind string, anchor_type string, anchor_id string, title string, body string, model string, confidence double")
    inputs = lambda i, t="entity", x=entity: spark.createDataFrame([(i, t, x)], "projection_id string, target_type string, target_id string")
    p, e = pages.write(g, none, bare, draft("p1"), inputs("p1"))
    assert p.count() == 1 and e.first()["content_hash"]
    same, _ = pages.write(g, p, e, draft("p2"), inputs("p2"))
    assert same.count() == 1
    changed = g.entities.filter(F.col("status") == "active").orderBy(F.desc("id")).first()["id"]
    two, e2 = pages.write(g, p, e, draft("p3"), inputs("p3").union(inputs("p3", x=changed)))
    rows = {r["id"]: r for r in two.collect()}
    assert rows["p1"]["superseded_by"] == "p3" and rows["p1"]["invalidated_at"] and rows["p3"]["invalidated_at"] is None
    assert [r["id"] for r in pages.search_pages(two, "words").collect()] == ["p3"]
    assert pages.pages_at(two, "2025-06-02 00:00:00").count() == 1 and pages.page_checks(two, e2).count() == 0
    with pytest.raises(pages.InputMissing):
        pages.write(g, none, bare, draft("p4"), inputs("p4", x="no such entity"))
    with pytest.raises(pages.Cycle):
        pages.write(g, none, bare, draft("p5"), inputs("p5", "projection", "p5"))
    state = inputs("p3").join(projections.current_hashes(g), ["target_type", "target_id"])
    r, _ = pages.refreshed(two, e2, state, spark.createDataFrame([("p3",)], "id string"))
    assert {x["input_fingerprint"] for x in r.collect()} == {rows["p1"]["input_fingerprint"]}


def test_checks_scopes_and_scores(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, superseded_by string")
    e = spark.createDataFrame([("a", "projection", "b", "input"), ("b", "entity", "x", "input")], "projection_id string, target_type string, target_id string, role string")
    assert {(r["check_name"], r["item_id"]) for r in pages.page_checks(p, e).collect()} == {("page_without_input", "c"), ("page_supersession_loop", "a>b")}
    assert pages.parse_scope("anchor:entity:1") == {"anchor_type": "entity", "anchor_id": "1"} and pages.parse_scope(None) == {}
    with pytest.raises(ValueError):
        pages.parse_scope("x")
    assert pages.proposal_errors({"kind": "entity_summary", "anchor_type": "none", "anchor_id": None, "title": "t", "inputs": [1]}) == [] and len(pages.proposal_errors({})) == 4
    s = pages.round_scores(spark.createDataFrame([(True, True, 4.0), (True, False, 1.0), (False, True, 1.0)], "expected boolean, found boolean, latency_ms double")).first()
    assert (s["recall"], s["precision"], s["f1"], s["latency"]) == (0.5, 0.5, 0.5, 4.0)
    runs = spark.createDataFrame([("completed", False, None, "2024-01-02"), ("completed", True, None, "2024-01-03"), ("completed", False, "kind:x", "2024-01-04")], "status string, dry_run boolean, scope string, started_at string")
    assert pages.round_cursor(runs, None).first()[0] == "2024-01-02"
    with pytest.raises(pages.ModelMismatch):
        pages.check_model("a", "b")
