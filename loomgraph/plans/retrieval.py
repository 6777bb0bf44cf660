"""Queries of retrieval: full text, scores, vectors, walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..graph import Graph, active
from ..operators import pages, search, traverse
from .graph_queries import NOW_SQL, ONCE, days_sql, valid_sql

QUERIES, SQL = {}, {}
QUERY = "vector cursor"
PHRASE = "authored by"


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            SQL[name] = ONCE + (", " + ctes if ctes else "") + sql
        return f

    return add


def fts(name: str, table: str, expr: str, phrases: list[list[str]], any_term: bool = False) -> str:
    """BM25 written out: hits of a table as a CTE (id, rank)."""
    tok = f"list_filter(string_split_regex(translate(lower(coalesce({expr}, '')), '{text.MARKED}', '{text.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    ph = ["".join(f" {t} " for t in p) for p in phrases]
    tf = ", ".join(f"(length(laid) - length(replace(laid, '{p}', ''))) / {len(p)} as tf{i}" for i, p in enumerate(ph))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(ph)))
    score = " + ".join(f"greatest(1e-6, ln((n_docs - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(ph)))
    where = (" or " if any_term else " and ").join(f"tf{i} > 0" for i in range(len(ph)))
    return (
        f"{name}_t as (select id, ' ' || array_to_string(tk, '  ') || ' ' laid, len(tk) len from (select id, {tok} tk from {table})), {name}_f as (select id, len, {tf} from {name}_t), "
        f"{name}_s as (select count(*) n_docs, avg(len) avg_len, {df} from {name}_f), {name} as (select id, round(-({score}), 6) \"rank\" from {name}_f, {name}_s where {where})"
    )


P = text.query_phrases(QUERY)
E_TEXT = "concat_ws(' ', canonical_name, summary)"
_E, _D, _C = fts("fe", "ent", E_TEXT, P), fts("fd", "edg", "fact", P), fts("fc", "epi", "content", P)
query("T2_T5_search_entities", "select id, \"rank\" from fe where id in (select id from ent where status = 'active')", _E)(lambda g: search.search_entities(g, QUERY))
query("T6_search_edges", "select id, \"rank\" from fd where id in (select id from edg where invalidated_at is null)", _D)(lambda g: search.search_edges(g, QUERY))
query("T13_search_edges_as_of", "select id, \"rank\" from fd where id in (select id from edg where created_at <= timestamp '2023-06-01' and (invalidated_at is null or invalidated_at > timestamp '2023-06-01'))", _D)(lambda g: search.search_edges(g, QUERY, as_of="2023-06-01 00:00:00"))
query("T7_search_episodes", "select id, \"rank\" from fc where id in (select id from epi where status = 'active')", _C)(lambda g: search.search_episodes(g, QUERY))
query("T3_phrase_search", "select id, \"rank\" from fp where id in (select id from edg where invalidated_at is null)", fts("fp", "edg", "fact", [["authored", "by"], ["bot"]]))(lambda g: search.search_edges(g, "authored_by bot"))
query("T14_any_term", "select id, \"rank\" from fo where id in (select id from epi where status = 'active')", fts("fo", "epi", "content", [["ownership"], ["edge"], ["fingerprint"]], True))(lambda g: search.search_episodes(g, " ".join(text.topic_terms("Which ownership edge is in the fingerprint?")), any_term=True))
query(
    "T1_postings",
    "select term, count(*) as n_docs, cast(sum(tf) as bigint) as n_occurrences from (select id, term, count(*) tf from (select id, unnest(tk) term from (select id, list_filter(string_split_regex(translate(lower(fact), '" + text.MARKED + "', '" + text.PLAIN + "'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') tk from edg)) group by 1, 2) group by 1",
)(lambda g: text.postings(g.edges, "id", F.col("fact")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_occurrences")))
query("T10_like_fallback", "select id, canonical_name, -0.5::double as \"rank\" from ent where status = 'active' and (lower(canonical_name) like '%snapshot%' or lower(canonical_name) like '%snapsho%') order by length(canonical_name), canonical_name, id limit 10")(lambda g: search.like_fallback(g, "snapshot"))
_DISC = fts("fq", "epi", "content", P, True) + ", dis as (select fq.id, source_type, \"rank\" from fq join epi using (id) where status = 'active' order by case source_type when 'github_pr' then 0 when 'github_issue' then 1 when 'git_commit' then 2 else 3 end, \"rank\", fq.id limit 20)"
query("T12_discussions", "select * from dis", _DISC)(lambda g: search.discussions(g, QUERY))
query("V16_discussion_confidence", "select id, source_type, round(0.75 * abs(\"rank\") / abs((select min(\"rank\") from dis)) + 0.25 * case source_type when 'github_pr' then 1.0 when 'github_issue' then 0.9 when 'git_commit' then 0.7 else 0.6 end, 6) as confidence from dis", _DISC)(lambda g: search.discussion_confidence(g, QUERY))
query("W6_normalized_ranks", "select id, \"rank\", case when (select max(\"rank\") = min(\"rank\") from fd) then 1.0 else ((select max(\"rank\") from fd) - \"rank\") / ((select max(\"rank\") from fd) - (select min(\"rank\") from fd)) end as fts from fd", _D)(lambda g: search.normalized(text.bm25(g.edges, "id", F.col("fact"), P)))
query(
    "V1_V3_scores",
    f"select e.id, round(exp(-greatest(0.0, {days_sql(NOW_SQL, 'updated_at')}) * ln(2) / 30), 6) as temporal, round(case when coalesce(n, 0) <= 0 then 0 else least(1.0, ln(1 + n) / ln(101)) end, 6) as evidence, round(case when coalesce(d, 0) <= 0 then 0 else least(1.0, ln(1 + d) / ln(51)) end, 6) as graph from ent e left join (select entity_id, count(*) n from ev group by 1) v on v.entity_id = e.id left join (select entity_id, count(*) d from tou where invalidated_at is null group by 1) t on t.entity_id = e.id",
)(
    lambda g: g.entities.select("id", "updated_at")
    .join(g.entity_evidence.select("entity_id", "episode_id").distinct().groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left")
    .join(active(g.touching).groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left")
    .select("id", F.round(search.temporal_score(F.lit(g.now).cast("timestamp_ntz"), F.col("updated_at")), 6).alias("temporal"), F.round(search.evidence_score(F.coalesce("n", F.lit(0))), 6).alias("evidence"), F.round(search.graph_score(F.coalesce("d", F.lit(0))), 6).alias("graph"))
)
_COS = "case when len(a.vector) = len(q.vector) and list_sum(list_transform(a.vector, lambda x: x::double * x::double)) > 0 and list_sum(list_transform(q.vector, lambda x: x::double * x::double)) > 0 then greatest(0, least(1, list_inner_product(a.vector::double[], q.vector::double[]) / (sqrt(list_inner_product(a.vector::double[], a.vector::double[])) * sqrt(list_inner_product(q.vector::double[], q.vector::double[]))))) else 0 end"
query("V5_V6_similar", f"select a.id, a.target_type, a.target_id, round({_COS}, 6) as score from emb a, (select * from emb where id = (select min(id) from emb where len(vector) = dimensions)) q where a.model = q.model and a.id <> q.id order by score desc, a.id limit 20")(lambda g: search.similar_to(g, g.embeddings.filter("size(vector) = dimensions").agg(F.min("id")).first()[0]))
query("V7_latest_embeddings", "select id, target_type, target_id, model from (select *, row_number() over (partition by target_type, target_id, model order by created_at desc, id desc) r from emb) where r = 1")(lambda g: search.latest_embeddings(g).select("id", "target_type", "target_id", "model"))
query("V9_J6_embedding_gap", "select target_type, target_id from (select 'entity' target_type, id target_id from ent where status = 'active' union all select 'episode', id from epi where status = 'active') t where not exists (select 1 from emb e where e.model = 'lattice-96' and e.target_type = t.target_type and e.target_id = t.target_id)")(lambda g: search.embedding_gap(g, "lattice-96"))

# walks

_STEPS = "steps as (select source_id here, target_id there, confidence c from edg where invalidated_at is null and relation_type in ('likely_owner_of', 'co_changes_with') union all select target_id, source_id, confidence from edg where invalidated_at is null and relation_type in ('likely_owner_of', 'co_changes_with'))"
_SEEDS = "seeds as (select id, 1.0 seed_score from ent where entity_type = 'service')"


def reach_sql(seeds: str) -> str:
    best = "select id, max(s.confidence) confidence, max_by(s.seed_score, struct_pack(a := s.confidence, b := s.seed_score)) seed_score"
    hop = "select there id, {conf} confidence, f.seed_score from {f} f join steps on here = f.id where there not in (select id from {v}) and there in (select id from ent where status = 'active')"
    return f"{seeds}, {_STEPS}, h1 as ({best} from ({hop.format(conf='c', f='seeds', v='seeds')}) s group by id), v1 as (select id from seeds union all select id from h1), h2 as ({best} from ({hop.format(conf='least(f.confidence, c)', f='h1', v='v1')}) s group by id), walked as (select id, 1 hops, confidence, seed_score from h1 union all select id, 2, confidence, seed_score from h2)"


query("G1_reach", "select id, hops, confidence from walked", reach_sql(_SEEDS))(lambda g: traverse.reach(g, g.entities.filter("entity_type = 'service'").select("id", F.lit(1.0).alias("seed_score"))).select("id", "hops", "confidence"))
_NEAR = "st as (select distinct source_id here, target_id there from edg where invalidated_at is null union select target_id, source_id from edg where invalidated_at is null), near as (select id as start, id, 0 as depth from ent where entity_type = 'service' union select n.start, s.there, n.depth + 1 from near n join st s on s.here = n.id where n.depth < 2)"
query("G2_neighbours", "select start, id, min(depth) as depth from near group by 1, 2", _NEAR)(lambda g: traverse.neighbours(g, g.entities.filter("entity_type = 'service'").select("id"), depth=2))
query("G2_neighbours_out", "select start, id, min(depth) as depth from near group by 1, 2", "st as (select distinct source_id here, target_id there from edg where invalidated_at is null and edge_kind = 'observed'), near as (select id as start, id, 0 as depth from ent where entity_type = 'module' union select n.start, s.there, n.depth + 1 from near n join st s on s.here = n.id where n.depth < 1)")(lambda g: traverse.neighbours(g, g.entities.filter("entity_type = 'module'").select("id"), 1, ["observed"], direction="out"))
_GOAL = "(select min(id) from ent where entity_type = 'k8s_resource_kind')"
query(
    "G3_shortest_path",
    f"select start, id as goal, length from (select start, id, min(depth) as length from near where id = {_GOAL} group by 1, 2)",
    _NEAR.replace("n.depth < 2", "n.depth < 5"),
)(lambda g: traverse.shortest_paths(g, g.entities.filter("entity_type = 'service'").select("id"), g.entities.filter("entity_type = 'k8s_resource_kind'").agg(F.min("id").alias("id"))).select("start", "goal", "length"))
query(
    "G6_G7_cycles",
    "select distinct array_to_string(list_sort(path), '>') as cycle from w where nxt = start",
    "lk as (select distinct upper(trim(id)) c, upper(trim(superseded_by)) p from edg where trim(superseded_by) <> ''), w as (select c as start, p as nxt, [c] as path from lk union select w.start, lk.p, list_append(w.path, w.nxt) from w join lk on lk.c = w.nxt where w.nxt <> w.start and not list_contains(w.path, w.nxt) and len(w.path) < 64)",
)(lambda g: traverse.cycles(g.edges.filter("trim(superseded_by) <> ''").select(F.upper(F.trim("id")).alias("c"), F.upper(F.trim("superseded_by")).alias("p")), "c", "p"))
query("G8_W9_top_co_changes", "select entity_id, other, weight, r as \"rank\" from (select entity_id, case when source_id = entity_id then target_id else source_id end other, weight, row_number() over (partition by entity_id order by weight desc nulls last, id) r from tou where invalidated_at is null and relation_type = 'co_changes_with' and source_id <> target_id) where r <= 5")(traverse.top_co_changes)
query("G9_owner_links", "select entity_id, id as edge_id, row_number() over (partition by entity_id order by valid_from desc nulls last, id) as \"rank\" from tou where invalidated_at is null and relation_type = 'likely_owner_of'")(traverse.owner_links)
query("G10_whole_graph", "select 'node' as item, id, canonical_name as label from ent union all select 'edge', id, relation_type from edg where invalidated_at is null")(traverse.nodes_and_edges)

# composite search

_NORM = "{n}n as (select id, case when (select max(\"rank\") = min(\"rank\") from {n}a) then 1.0 else ((select max(\"rank\") from {n}a) - \"rank\") / ((select max(\"rank\") from {n}a) - (select min(\"rank\") from {n}a)) end fts from {n}a)"
_SEARCH = (
    f"{_E}, {_D}, {_C}, fea as (select * from fe where id in (select id from ent where status = 'active')), fda as (select * from fd where id in (select id from edg where invalidated_at is null)), fca as (select * from fc where id in (select id from epi where status = 'active')), "
    + ", ".join(_NORM.format(n=n) for n in ("fe", "fd", "fc"))
    + ", "
    + reach_sql("seeds as (select id, fts seed_score from fen)")
    + f""", found as (select id, fts from fen union all select id, seed_score * case hops when 1 then 0.85 else 0.55 end from walked where id not in (select id from fen)),
sc as (select 'entity' "type", f.id, f.fts, case when coalesce(n, 0) <= 0 then 0 else least(1.0, ln(1 + n) / ln(101)) end evidence, exp(-greatest(0.0, {days_sql(NOW_SQL, 'e.updated_at')}) * ln(2) / 30) temporal, case when coalesce(d, 0) <= 0 then 0 else least(1.0, ln(1 + d) / ln(51)) end graph, canonical_name "content"
  from found f join ent e using (id) left join (select entity_id, count(*) n from ev group by 1) v on v.entity_id = f.id left join (select entity_id, count(*) d from tou where invalidated_at is null group by 1) t on t.entity_id = f.id
union all select 'edge', f.id, f.fts, case when coalesce(n, 0) <= 0 then 0 else least(1.0, ln(1 + n) / ln(101)) end, exp(-greatest(0.0, {days_sql(NOW_SQL, 'd.created_at')}) * ln(2) / 30), 0.0, fact from fdn f join edg d using (id) left join (select edge_id, count(*) n from eev group by 1) v on v.edge_id = f.id
union all select 'episode', f.id, f.fts, 1.0, exp(-greatest(0.0, {days_sql(NOW_SQL, 'p.timestamp')}) * ln(2) / 30), 0.0, case when length(p.content) > 200 then substr(p.content, 1, 200) || '…' else p.content end from fcn f join epi p using (id)),
res as (select "type", id, round(0.4 * fts + 0.3 * evidence + 0.2 * temporal + 0.1 * graph, 6) as score, round(fts, 6) as fts, round(evidence, 6) as evidence, round(temporal, 6) as temporal, round(graph, 6) as graph, 0.0::double as vector, "content" from sc)"""
)
query("V12_search", 'select * from res order by score desc, "type", id limit 20', _SEARCH)(lambda g: search.search(g, QUERY))
query("V4_V14_search_all", "select * from res", _SEARCH)(lambda g: search.search(g, QUERY, limit=None))
_HYBRID = (
    _SEARCH
    + f""", q as (select * from emb where id = (select min(id) from emb where len(vector) = dimensions)),
v100 as (select target_type, target_id, max(score) score from (select a.target_type, a.target_id, round({_COS}, 6) score, row_number() over (partition by a.target_type order by round({_COS}, 6) desc, a.id) r from emb a, q where a.model = q.model and a.id <> q.id) where r <= 100 group by 1, 2),
hy as (select sc.*, coalesce(case "type" when 'entity' then greatest((select score from v100 where target_type = 'entity' and target_id = sc.id), (select max(score) from ev join v100 on target_type = 'episode' and target_id = ev.episode_id where ev.entity_id = sc.id)) when 'episode' then (select score from v100 where target_type = 'episode' and target_id = sc.id) end, 0.0) vector from sc)"""
)
query("V11_hybrid_search", 'select "type", id, round(0.35 * fts + 0.25 * evidence + 0.15 * temporal + 0.1 * graph + 0.15 * vector, 6) as score, round(fts, 6) as fts, round(evidence, 6) as evidence, round(temporal, 6) as temporal, round(graph, 6) as graph, vector, "content" from hy order by score desc, "type", id limit 20', _HYBRID)(lambda g: search.search(g, QUERY, mode="hybrid", like=g.embeddings.filter("size(vector) = dimensions").agg(F.min("id")).first()[0]))
query(
    "V13_W7_anchored",
    "select id, 0 as tier, 1.0::double as score from seeds union all select id, least(hops, 2), round(case when hops = 1 then 0.5 + 0.5 * confidence / max(confidence) over (partition by least(hops, 2)) else 0.5 * confidence / max(confidence) over (partition by least(hops, 2)) end, 6) from walked",
    reach_sql("seeds as (select id, 1.0 seed_score from ent where canonical_name = (select min(canonical_name) from ent where entity_type = 'file') order by created_at, id limit 1)"),
)(lambda g: search.anchored(g, g.entities.filter("entity_type = 'file'").agg(F.min("canonical_name")).first()[0]))
_FALL = """ep as (select id episode_id, lower(content) body from epi where status = 'active' and lower(content) like '%fingerprint%' and lower(content) like '%lattice%'),
mt as (select ev.entity_id, canonical_name, sum(case when length(stem) > 0 then (length(body) - length(replace(body, stem, ''))) / length(stem) else 0 end) n from ev join ep using (episode_id) join (select id entity_id, canonical_name, lower(regexp_extract(canonical_name, '([^/]+?)(\\.[A-Za-z0-9]+)?$', 1)) stem from ent where status = 'active') using (entity_id) group by 1, 2),
fb as (select entity_id as id, canonical_name, case when lower(canonical_name) like '%fingerprint%' or lower(canonical_name) like '%lattice%' then -0.5 when n >= 5 then -0.45 when n >= 1 then -0.35 else -0.3 end::double as "rank" from mt)"""
query("T11_J15_episode_fallback", 'select * from fb order by "rank", length(canonical_name), canonical_name, id limit 10', _FALL)(lambda g: search.episode_fallback(g, ["fingerprint", "lattice"]))
query("V17_rank_shares", 'select id, "rank", round(abs("rank") / abs((select min("rank") from fd)), 6) as share from fd', _D)(lambda g: search.shares(text.bm25(g.edges, "id", F.col("fact"), P)))
query("V10_reindexed")(lambda g: pages.reindexed(g, "hash-words-64"))
query("T8_search_pages", 'select id, "rank" from fg', fts("fg", "(select id, canonical_name, summary from ent where entity_type = 'module')", E_TEXT, [["cursor"]]))(lambda g: text.bm25(g.entities.filter("entity_type = 'module'"), "id", search.entity_text(), text.query_phrases("cursor")))
