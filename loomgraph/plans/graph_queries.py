"""Queries over the graph: lookups, time, counts, decay, ownership and integrity; names begin with the operator's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import ENTITY_TYPES, EPISODE_SOURCES, INGESTION_SOURCES, NOW, RELATION_TYPES, Graph, active, at, known_at, valid_at
from ..operators import decay, lookup, stats, temporal, verify

A, B = "2022-06-01 00:00:00", "2023-06-01 00:00:00"
PREFIX = "ingest"

#: Each record once; every query's SQL starts from these.
ONCE = """with recursive ent as (select distinct * from entities), ali as (select distinct * from entity_aliases), edg as (select distinct * from edges), epi as (select distinct * from episodes),
evi as (select distinct * from entity_evidence), run as (select distinct * from ingestion_runs), emb as (select distinct * from stored_embeddings),
ev as (select distinct entity_id, episode_id from entity_evidence),
tou as (select source_id entity_id, * from edg union all select target_id, * from edg where target_id <> source_id),
eev as (select distinct e.id edge_id, a.episode_id from edg e join ev a on a.entity_id = e.source_id join ev b on b.entity_id = e.target_id and b.episode_id = a.episode_id),
lev as (select ev.entity_id, ev.episode_id, p.timestamp, p.actor, p.owner_id from ev join epi p on p.id = ev.episode_id where p.status <> 'redacted')
"""
NOW_SQL = f"timestamp '{NOW}'"


def valid_sql(t: str, p: str = "") -> str:
    return f"({p}valid_from is null or {p}valid_from <= {t}) and ({p}valid_until is null or {p}valid_until > {t})"


def days_sql(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def words(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            SQL[name] = ONCE + (", " + ctes if ctes else "") + sql
        return f

    return add


# lookups

query("F1_get_entity", "select id, canonical_name, entity_type from ent where id = (select min(id) from ent)")(lambda g: g.entities.join(F.broadcast(g.entities.agg(F.min("id").alias("m"))), F.col("id") == F.col("m")).select("id", "canonical_name", "entity_type"))
query("F2_find_entities", "select id, canonical_name, status from ent where entity_type = 'file' and status = 'active'")(lambda g: lookup.find_entities(g, type="file", status="active").select("id", "canonical_name", "status"))
query("F3_find_edges", f"select id, source_id, target_id from edg where relation_type = 'likely_owner_of' and edge_kind = 'observed' and created_at <= timestamp '{B}' and (invalidated_at is null or invalidated_at > timestamp '{B}') and {valid_sql(f"timestamp '{A}'")}")(
    lambda g: temporal.find_edges(g, relation="likely_owner_of", kind="observed", valid=A, as_of=B).select("id", "source_id", "target_id")
)
query("F4_valid_at", f"select relation_type, count(*) as n from edg where invalidated_at is null and {valid_sql(f"timestamp '{A}'")} group by 1")(lambda g: stats.relation_counts(active(g.edges).filter(valid_at(at(A)))))
query("F5_known_at", f"select relation_type, count(*) as n from edg where created_at <= timestamp '{A}' and (invalidated_at is null or invalidated_at > timestamp '{A}') group by 1")(lambda g: stats.relation_counts(g.edges.filter(known_at(at(A)))))
query("F6_current_episodes", "select source_type, source_ref, id from epi where source_ref is not null and superseded_by is null")(lambda g: lookup.current_episodes(g).select("source_type", "source_ref", "id"))
query(
    "F7_resolve_entity",
    "select name, entity_id, via from (select *, row_number() over (partition by name order by via_n, alias_at desc nulls last, entity_at, entity_id, alias_id) r from cand) where r = 1",
    f"""names as (select distinct alias as name from ali where alias is not null), cand as (
  select name, id entity_id, 'name' via, 0 via_n, null::timestamp alias_at, created_at entity_at, '' alias_id from names join ent on canonical_name = name
  union all select name, entity_id, 'alias', 1, a.created_at, e.created_at, a.id from names join ali a on a.alias = name join ent e on e.id = a.entity_id where {valid_sql(NOW_SQL, "a.")})""",
)(lambda g: lookup.resolve_entities(g, g.aliases.select(F.col("alias").alias("name"))))
query("F8_J1_evidence", "select v.entity_id, v.episode_id, v.extractor, p.source_type, p.status from evi v join epi p on p.id = v.episode_id")(lambda g: lookup.evidence_of_entities(g).select("entity_id", "episode_id", "extractor", "source_type", "status"))
query("F9_snapshot", f"select 'entity' as item, id from ent where status = 'active' union all select 'edge', id from edg where invalidated_at is null and {valid_sql(f"timestamp '{A}'")}")(lambda g: temporal.snapshot(g, A))
query("F10_fact_history", "select source_id, target_id, id, relation_type, row_number() over (partition by source_id, target_id order by valid_from asc nulls first, created_at, id) as position from edg")(temporal.fact_history)
query(
    "F11_entity_history",
    "select t.entity_id, t.id as edge_id, case when t.source_id = t.entity_id then 'out' else 'in' end as direction, relation_type, created_at from (select * exclude (entity_id), entity_id from tou) t where t.entity_id in (select id from ent where canonical_name = (select min(canonical_name) from ent where entity_type = 'module'))",
)(lambda g: temporal.entity_history(g, g.entities.filter("entity_type = 'module'").agg(F.min("canonical_name")).first()[0]))
query("F12_show_entity", "select e.id, count(distinct t.id) filter (where t.source_id = e.id) as n_out, count(distinct t.id) filter (where t.target_id = e.id) as n_in, (select count(*) from evi v where v.entity_id = e.id) as n_evidence from ent e left join tou t on t.entity_id = e.id where e.entity_type = 'service' group by e.id")(
    lambda g: g.entities.filter("entity_type = 'service'")
    .select("id")
    .join(g.touching.groupBy(F.col("entity_id").alias("id")).agg(F.count_if(F.col("source_id") == F.col("entity_id")).alias("n_out"), F.count_if(F.col("target_id") == F.col("entity_id")).alias("n_in")), "id", "left")
    .join(g.entity_evidence.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n_evidence")), "id", "left")
    .na.fill(0)
)
query("F13_path_target", "select id, canonical_name, step from hits where step = (select min(step) from hits) order by length(canonical_name), canonical_name, id limit 10", "hits as (select id, canonical_name, case when canonical_name = 'cursor.py' then 0 when lower(canonical_name) like '%cursor.py' and entity_type in ('file', 'module') then 1 when lower(canonical_name) like '%cursor.py' then 2 end step from ent where status = 'active')")(
    lambda g: lookup.path_targets(g, "cursor.py")
)
query("F14_symbol_target", "select id, canonical_name, step from hits where step = (select min(step) from hits) order by length(canonical_name), canonical_name, id limit 20", "hits as (select id, canonical_name, case when canonical_name = 'Vector' then 0 when lower(canonical_name) like '%::vector' then 1 when lower(canonical_name) like '%vector%' then 2 end step from ent where status = 'active' and entity_type = 'symbol')")(
    lambda g: lookup.symbol_targets(g, "Vector")
)
query("F16_area_children", f"select id, canonical_name from ent where starts_with(canonical_name, '{PREFIX}/')")(lambda g: lookup.area_children(g, PREFIX).select("id", "canonical_name"))
query("F17_episode_by_number", "select id, source_ref, r as rank from (select id, source_ref, timestamp, case when source_ref = '649' then 0 when source_ref = '#649' then 1 when source_ref like '%/pull/649' then 2 when source_ref like '%/issues/649' then 3 end r from epi) where r is not null order by r, timestamp, id limit 1")(
    lambda g: lookup.episode_by_number(g, 649)
)
query("F18_without_noise", "select id from ent where not (regexp_matches(canonical_name, '::[A-Z0-9_]+$') or split_part(canonical_name, '/', -1) in ('package-lock.json', 'yarn.lock', 'bun.lock', 'Cargo.lock', 'go.sum') or regexp_matches(canonical_name, '(^|/)(dist|build|node_modules|test|tests)/'))")(
    lambda g: lookup.without_noise(g.entities).select("id")
)
query(
    "F19_view_filter",
    "select v.id, canonical_name, degree from v join (select entity_id, count(*) degree from (select t.entity_id, t.id from tou t where invalidated_at is null and relation_type in ('imports', 'contains') and source_id in (select id from v) and target_id in (select id from v)) group by 1) d on d.entity_id = v.id where degree >= 1",
    "v as (select id, canonical_name from ent where entity_type in ('file', 'module'))",
)(lambda g: lookup.neighbourhood_view(g, ["file", "module"], ["imports", "contains"], 1))
query("F20_redaction", "select id, status, " + ", ".join(f"case when status <> 'redacted' then {c} end as {c}" for c in ("source_type", "source_ref", "content_hash", "actor")) + " from epi")(lookup.masked_episodes)

# time

query("D9_D10_diff", f"select edge_id, bucket from (select id as edge_id, case when {valid_sql(f"timestamp '{A}'")} and {valid_sql(f"timestamp '{B}'")} then 'unchanged' when {valid_sql(f"timestamp '{A}'")} then case when trim(superseded_by) <> '' then 'superseded' else 'invalidated' end when {valid_sql(f"timestamp '{B}'")} then 'added' when valid_from > timestamp '{A}' and valid_until <= timestamp '{B}' then 'transient' end bucket from edg) where bucket is not null")(
    lambda g: temporal.diff(g, A, B)
)
query("A21_diff_counts", f"select relation_type, count(*) as n from edg where {valid_sql(f"timestamp '{B}'")} and not ({valid_sql(f"timestamp '{A}'")}) group by 1")(lambda g: stats.relation_counts(g.edges.join(temporal.diff(g, A, B).filter("bucket = 'added'").select(F.col("edge_id").alias("id")), "id", "left_semi")))
_DOM = "(select target_id, source_id from (select *, row_number() over (partition by target_id order by weight desc nulls last, confidence desc, id desc) r from edg where relation_type = 'likely_owner_of' and {v}) where r = 1)"
query("D12_W4_ownership_shifts", f"select coalesce(a.target_id, b.target_id) as entity_id, a.source_id as owner_before, b.source_id as owner_after from {_DOM.format(v=valid_sql(f"timestamp '{A}'"))} a full join {_DOM.format(v=valid_sql(f"timestamp '{B}'"))} b on a.target_id = b.target_id where a.source_id is distinct from b.source_id")(
    lambda g: temporal.ownership_shifts(g, A, B)
)
_KEYS4 = ["source_id", "target_id", "relation_type", "edge_kind"]
_OVER = "(a.valid_from is null or b.valid_until is null or a.valid_from < b.valid_until) and (b.valid_from is null or a.valid_until is null or b.valid_from < a.valid_until)"
query("J7_overlapping_edges", f"select a.id as edge_a, b.id as edge_b, a.source_id, a.target_id, a.relation_type, a.edge_kind from edg a join edg b using (source_id, target_id, relation_type, edge_kind) where a.id < b.id and a.invalidated_at is null and b.invalidated_at is null and {_OVER}")(lambda g: temporal.overlaps(g.edges, _KEYS4))
query("J8_conflicts", "select p.id as proposed_id, min(e.id) as conflict_id from edg p join edg e using (source_id, target_id, relation_type, edge_kind) where p.invalidated_at is not null and e.invalidated_at is null and e.id <> p.id and not ((p.valid_from is not null and e.valid_until is not null and e.valid_until <= p.valid_from) or (p.valid_until is not null and e.valid_from is not null and p.valid_until <= e.valid_from)) group by 1")(
    lambda g: temporal.conflicts(g, g.edges.filter("invalidated_at is not null"))
)
_NEW = "new as (select 'n:' || id id, source_id, target_id, relation_type, edge_kind, fact, weight, valid_until valid_from, null::timestamp valid_until, created_at, null::timestamp invalidated_at, null superseded_by, confidence, owner_id, id replaces from edg where relation_type = 'likely_owner_of')"
query(
    "D14_supersede_edges",
    f"select id, valid_until, invalidated_at, superseded_by from (select e.id, case when n.id is not null and e.invalidated_at is null then coalesce(n.valid_from, {NOW_SQL}) else e.valid_until end valid_until, case when n.id is not null and e.invalidated_at is null then {NOW_SQL} else e.invalidated_at end invalidated_at, case when n.id is not null and e.invalidated_at is null then n.id else e.superseded_by end superseded_by from edg e left join new n on n.replaces = e.id union all select n.id, n.valid_until, n.invalidated_at, n.superseded_by from new n join edg e on e.id = n.replaces where e.invalidated_at is null)",
    _NEW,
)(
    lambda g: temporal.supersede(
        g,
        g.edges.filter("relation_type = 'likely_owner_of'").withColumns({"replaces": F.col("id"), "id": F.concat(F.lit("n:"), "id"), "valid_from": F.col("valid_until"), "valid_until": F.lit(None).cast("timestamp_ntz"), "invalidated_at": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string")}),
    ).select("id", "valid_until", "invalidated_at", "superseded_by")
)
query("D16_time_slider", "select strftime(day, '%Y-%m-%d') as day, (select count(*) from edg where invalidated_at is null and (valid_from is null or valid_from <= day) and (valid_until is null or valid_until > day) and (valid_from is null or valid_until is null or valid_until > valid_from)) as n_edges from steps", "steps as (select unnest(generate_series(min(valid_from)::date::timestamp, greatest(max(valid_until), max(valid_from))::date::timestamp, interval 30 day)) as day from edg where invalidated_at is null)")(
    temporal.series
)
query("A3_temporal_bounds", "select min(valid_from) as min_valid_from, max(valid_until) as max_valid_until from edg where invalidated_at is null")(temporal.temporal_bounds)

# counts

query("A1_stats", "select (select count(*) from ent where status = 'active') as entities, count(*) filter (where invalidated_at is null) as edges, count(*) filter (where invalidated_at is not null) as invalidated_edges, (select count(*) from epi where status = 'active') as episodes, (select count(*) from ali) as aliases from edg")(stats.stats)
query("A2_shown_stats", "select (select count(*) from ent) as entity_count, (select count(*) from edg where invalidated_at is null) as edge_count, (select count(*) from epi) as episode_count")(stats.shown_stats)
query("A27_status", "select 'entities' as section, entity_type as key, count(*) as n from ent group by 2 union all select 'edges', case when invalidated_at is null then 'active' else 'invalidated' end, count(*) from edg group by 2 union all select 'episodes', status, count(*) from epi group by 2")(stats.status_report)
query("A14_dominant_source", "select entity_id, source_type, n from (select ev.entity_id, p.source_type, count(*) n, row_number() over (partition by ev.entity_id order by count(*) desc, p.source_type) r from ev join epi p on p.id = ev.episode_id group by 1, 2) where r = 1")(stats.dominant_sources)
query("A16_count_embeddings", "select count(*) filter (where target_type = 'entity') as entities, count(*) filter (where target_type = 'episode') as episodes from emb")(stats.count_embeddings)
query("A17_J16_embedding_coverage", "select t.target_type, count(e.target_id) as embedded, count(*) as total, cast(floor(count(e.target_id) * 100.0 / count(*) + 0.5) as int) as percent from (select 'entity' target_type, id from ent where status = 'active' union all select 'episode', id from epi where status = 'active') t left join (select distinct target_type, target_id from emb) e on e.target_type = t.target_type and e.target_id = t.id group by 1")(stats.embedding_coverage)
query("A18_fan_in", "select superseded_by, count(*) as n from epi where superseded_by is not null group by 1 having count(*) > 1")(stats.fan_in)
query("S23_W2_cursors", "select source_type, source_scope, cursor from (select *, row_number() over (partition by source_type, source_scope order by completed_at desc, id desc) r from run where status = 'completed' and cursor is not null) where r = 1")(stats.cursors)
query("S24_run_log", "select source_type, status, count(*) as n_runs, cast(sum(episodes_created) as bigint) as episodes, cast(sum(entities_created) as bigint) as entities, cast(sum(edges_created) as bigint) as edges from run group by 1, 2")(stats.run_log)
_FRESH = f"fr as (select source_type, source_scope, days, case when days is null then 'unknown' when days >= 30 then 'stale' when days >= 7 then 'warn' else 'fresh' end state from (select source_type, source_scope, cast(floor({days_sql(NOW_SQL, "max(completed_at) filter (where status = 'completed')")}) as bigint) as days from run group by 1, 2))"
query("A19_freshness", "select source_type, source_scope, days, state from fr", _FRESH)(stats.freshness)
query("A19_overall_freshness", "select case max(case state when 'fresh' then 0 when 'unknown' then 1 when 'warn' then 2 else 3 end) when 0 then 'fresh' when 1 then 'unknown' when 2 then 'warn' else 'stale' end as state, count(*) as n_scopes from fr", _FRESH)(stats.overall_freshness)

# decay and ownership

_SEV = "case when age > 1440 then 'critical' when age > 720 then 'high' when age > 360 then 'medium' when age > 180 then 'low' end"
_ACTIVE = "(select id from ent where status = 'active')"
_CTES = f"""
d4 as (select 'stale_evidence' category, 'entity' item_type, item_id, {_SEV} severity from (select entity_id item_id, {days_sql(NOW_SQL, "max(timestamp)")} age from lev group by 1) where item_id in {_ACTIVE} and age > 180),
d4e as (select 'stale_evidence' category, 'edge' item_type, item_id, {_SEV} severity from (select edge_id item_id, {days_sql(NOW_SQL, "max(p.timestamp)")} age from eev join epi p on p.id = eev.episode_id where p.status <> 'redacted' group by 1) where item_id in (select id from edg where invalidated_at is null) and age > 180),
d5 as (select 'contradicted' category, 'edge' item_type, id item_id, case when age <= 180 then 'medium' else 'low' end severity from (select id, {days_sql(NOW_SQL, "invalidated_at")} age from edg where trim(superseded_by) <> '' and invalidated_at is not null) where age between 0 and 360),
d6 as (select 'concentrated_risk' category, 'entity' item_type, a.entity_id item_id, case when no = 1 then 'high' else 'medium' end severity from (select entity_id, count(*) ne from tou where invalidated_at is null group by 1) a join (select entity_id, count(distinct coalesce(nullif(owner_id, ''), nullif(actor, ''))) no from lev group by 1) b using (entity_id) where ne >= 3 and no between 1 and 2 and a.entity_id in {_ACTIVE}),
aw as (select entity_id, actor, sum(round(exp(-greatest(0.0, {days_sql(NOW_SQL, "timestamp")}) * ln(2) / 90), 9)) weight, max(timestamp) last from lev where actor is not null and actor <> '' group by 1, 2),
ta as (select entity_id, actor, round(weight, 6) weight, last from (select *, row_number() over (partition by entity_id order by round(weight, 6) desc, actor) r from aw) where r = 1),
d7 as (select 'dormant_owner' category, 'entity' item_type, entity_id item_id, case when age > 180 then 'high' else 'medium' end severity from (select entity_id, {days_sql(NOW_SQL, "last")} age from ta) where age > 90 and entity_id in {_ACTIVE}),
d8 as (select 'orphaned' category, 'entity' item_type, id item_id, 'low' severity from ent where status = 'active' and id not in (select entity_id from tou where invalidated_at is null)),
rep as (select * from d4 union all select * from d4e union all select * from d5 union all select * from d6 union all select * from d7 union all select * from d8),
so as (select target_id entity_id, source_id "owner", confidence from (select *, row_number() over (partition by target_id order by confidence desc, id) r from edg where relation_type = 'likely_owner_of' and invalidated_at is null and {valid_sql(NOW_SQL)}) where r = 1),
co as (select entity_id, count(*) coupling from tou where invalidated_at is null and relation_type = 'co_changes_with' group by 1),
oa as (select coalesce(a.o, s.o) "owner", coalesce(av, sv) "last" from (select target_id o, max(valid_from) av from edg where invalidated_at is null and relation_type = 'authored_by' group by 1) a full join (select entity_id o, max(timestamp) sv from lev group by 1) s on a.o = s.o),
ow as (select e.id entity_id, e.canonical_name, so.owner, so.confidence, cast(floor({days_sql(NOW_SQL, "oa.last")}) as bigint) days_silent, coalesce(coupling, 0) coupling, d6.item_id is not null con from ent e join so on so.entity_id = e.id left join oa on oa.owner = so.owner left join co on co.entity_id = e.id left join d6 on d6.item_id = e.id where e.status = 'active' and so.confidence >= 0.1 and e.id in (select entity_id from evi)),
owr as (select * exclude (con), case when coalesce(days_silent > 180, false) and (con or coupling >= 10) then 'critical' when coalesce(days_silent > 180, false) or con or coupling >= 10 then 'elevated' else 'stable' end risk from ow)
"""
for _name, _part, _f in (("A4_stale_evidence", "d4", decay.stale), ("A4_stale_edges", "d4e", decay.stale_edges), ("A5_contradicted", "d5", decay.contradicted), ("A6_concentrated_risk", "d6", decay.concentrated), ("A7_dormant_owner", "d7", decay.dormant), ("A8_J4_orphaned", "d8", decay.orphaned)):
    query(_name, f"select * from {_part}", _CTES)(_f)
query("A9_decay_report", "select category, severity, count(*) as n from rep group by 1, 2", _CTES)(decay.summary)
query("A15_decay_overlay", "select entity_id, category, severity from (select item_id as entity_id, category, severity, row_number() over (partition by item_id order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, category) r from rep where item_type = 'entity' and category <> 'contradicted') where r = 1", _CTES)(decay.overlay)
query("W1_top_actor", 'select entity_id, actor, weight, "last" from ta', _CTES)(decay.top_actor)
query("A11_strongest_owner", 'select entity_id, "owner", confidence from so', _CTES)(decay.strongest_owner)
query("A12_owner_activity", 'select "owner", "last" from oa', _CTES)(decay.owner_activity)
query("A13_J3_coupling", "select * from co", _CTES)(decay.coupling)
query("A10_ownership_all", "select * from owr", _CTES)(lambda g: decay.ownership(g, limit=None))
query("A10_ownership_report", "select * from owr order by case risk when 'critical' then 0 when 'elevated' then 1 else 2 end, coupling desc, days_silent desc nulls last, entity_id limit 20", _CTES)(decay.ownership)

# integrity

_CHECKS = f"""
ck as (select 'entity_without_evidence' check_name, 'error' severity, id item_id from ent where id not in (select entity_id from evi)
union all select 'edge_without_evidence', 'error', id from edg where id not in (select edge_id from eev)
union all select 'edge_superseded_by_dangling', 'error', id from edg where superseded_by is not null and superseded_by not in (select id from edg)
union all select 'alias_episode_dangling', 'warning', id from ali where episode_id is not null and episode_id not in (select id from epi)
union all select 'evidence_episode_dangling', 'error', episode_id from ev where episode_id not in (select id from epi)
union all select 'embedding_target_dangling', 'warning', id from emb where (target_type = 'entity' and target_id not in (select id from ent)) or (target_type = 'edge' and target_id not in (select id from edg))
union all select 'active_edges_overlap', 'warning', a.id from edg a join edg b using (source_id, target_id, relation_type, edge_kind) where a.id < b.id and a.invalidated_at is null and b.invalidated_at is null and {_OVER}
union all select 'episode_fan_in', 'error', superseded_by from epi where superseded_by is not null group by 3 having count(*) > 1
union all select 'episode_superseded_by_dangling', 'error', id from epi where superseded_by is not null and superseded_by not in (select id from epi)
union all select 'entity_type_unknown', 'warning', id from ent where entity_type not in {words(ENTITY_TYPES)}
union all select 'relation_type_unknown', 'warning', id from edg where relation_type not in {words(RELATION_TYPES)}
union all select 'episode_source_unknown', 'warning', id from epi where source_type not in {words(EPISODE_SOURCES)}
union all select 'run_source_unknown', 'warning', id from run where source_type not in {words(INGESTION_SOURCES)})"""
query("C2_C13_J5_violations", "select * from ck", _CHECKS)(verify.violations)
query("C14_verdict", "select check_name, severity, count(*) as n from ck group by 1, 2", _CHECKS)(verify.verdict)
query("C14_valid", "select count(*) filter (where severity = 'error') = 0 as valid, count(*) filter (where severity = 'error') as n_errors, count(*) filter (where severity = 'warning') as n_warnings from ck", _CHECKS)(verify.valid)
