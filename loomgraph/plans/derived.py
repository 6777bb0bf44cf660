"""Queries of mining, cross references, derived documents and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import topic_terms
from ..graph import Graph
from ..operators import crossref, digest, mining, projections
from ..session import load
from .graph_queries import _CTES, NOW_SQL, ONCE, days_sql
from .retrieval import E_TEXT, fts

QUERIES, SQL = {}, {}
LOG_NOW, LOG_BEFORE = "2001-12-01 00:00:00", "1997-01-01 00:00:00"


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            SQL[name] = ONCE + (", " + ctes if ctes else "") + sql
        return f

    return add


# a commit log from the orders: an order is a commit, its customer the author, its parts the files

def touches(g: Graph) -> DataFrame:
    o = load(g.spark, g.path, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    return load(g.spark, g.path, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).join(o, "commit")


_LOG = 'tc as (select distinct l_orderkey "commit", l_partkey "file", o_custkey author, o_orderdate at_ from lineitem join orders on o_orderkey = l_orderkey)'


def owners_sql(name: str, now: str, where: str = "true") -> str:
    return f'{name}_s as (select "file", author, round(sum(round(exp(-greatest(0.0, {days_sql(f"timestamp \'{now}\'", "at_")}) * ln(2) / 90), 9)), 6) score from tc where {where} group by 1, 2), {name} as (select "file", author as "owner", score, least(score, 1.0) as confidence from (select *, row_number() over (partition by "file" order by score desc, author) r from {name}_s) where r = 1)'


query("D3_authored_by", 'select "file", author, "commit" from (select *, row_number() over (partition by "file", author order by at_ desc, "commit" desc) r from tc) where r = 1', _LOG)(lambda g: mining.authored(touches(g)))
query("D4_J12_co_changes", 'select file_a, file_b, n, least(n / 10.0, 1.0)::double as weight, 0.8::double as confidence, "commit" from (select a."file" file_a, b."file" file_b, count(*) n, max_by(a."commit", struct_pack(x := a.at_, y := a."commit")) "commit" from tc a join tc b on a."commit" = b."commit" and a."file" < b."file" group by 1, 2) where n >= 2', _LOG)(lambda g: mining.co_changes(touches(g), least=2))
query("D5_likely_owners", 'select * from lo', _LOG + ", " + owners_sql("lo", LOG_NOW))(lambda g: mining.likely_owners(touches(g), LOG_NOW))
query("D6_owner_changes", 'select n."file", o."owner" as owner_before, n."owner" as owner_after from lo n join lb o using ("file") where n."owner" <> o."owner"', _LOG + ", " + owners_sql("lo", LOG_NOW) + ", " + owners_sql("lb", LOG_BEFORE, f"at_ <= timestamp '{LOG_BEFORE}'"))(lambda g: mining.owner_changes(touches(g), LOG_BEFORE, LOG_NOW))
query("W5_introducing_commit", 'select "file", arg_min("commit", struct_pack(x := at_, y := "commit")) as "commit" from tc group by 1', _LOG)(lambda g: mining.introducing(touches(g)))
query(
    "D17_module_hierarchy",
    "select distinct array_to_string(p[1:i], '/') as parent, array_to_string(p[1:i + 1], '/') as child from (select p, unnest(range(1, len(p))) i from (select string_split(canonical_name, '/') p from ent where entity_type = 'file'))",
)(lambda g: mining.module_hierarchy(g.entities.filter("entity_type = 'file'").select(F.col("canonical_name").alias("path"))))
query("D1_episode_dedupe", "select source_type, source_ref, id from (select *, row_number() over (partition by source_type, source_ref order by ingested_at, id) r from epi where source_ref is not null) where r = 1 union all select source_type, source_ref, id from epi where source_ref is null")(
    lambda g: g.episodes.filter("source_ref is not null").groupBy("source_type", "source_ref").agg(F.min(F.struct("ingested_at", "id")).alias("m")).select("source_type", "source_ref", "m.id").unionByName(g.episodes.filter("source_ref is null").select("source_type", "source_ref", "id"))
)
query("D1_content_hash", "select id, content_hash, sha256(content) as computed from epi where content is not null and content_hash is not null and lower(trim(content_hash)) <> sha256(content)")(lambda g: g.episodes.filter("content is not null and content_hash is not null").select("id", "content_hash", F.sha2("content", 256).alias("computed")).filter("lower(trim(content_hash)) <> computed"))
query("D20_scope_counts", "select json_extract_string(metadata, '$.scope') as scope, count(*) as n, cast(sum(json_extract(metadata, '$.lines')::bigint) as bigint) as n_lines from epi where metadata is not null group by 1")(
    lambda g: g.episodes.filter("metadata is not null").select(F.get_json_object("metadata", "$.scope").alias("scope"), F.get_json_object("metadata", "$.lines").cast("long").alias("l")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("n_lines"))
)
query("D21_source_versions", "select split_part(source_ref, '@', 1) as path, count(*) as n_versions, arg_max(id, struct_pack(x := ingested_at, y := id)) as newest from epi where source_type = 'source' and source_ref is not null group by 1")(
    lambda g: g.episodes.filter("source_type = 'source' and source_ref is not null").groupBy(F.split("source_ref", "@")[0].alias("path")).agg(F.count(F.lit(1)).alias("n_versions"), F.max(F.struct("ingested_at", "id")).alias("m")).select("path", "n_versions", F.col("m.id").alias("newest"))
)

# cross references


def _pattern_sql() -> str:
    rows = []
    for i, p in enumerate(crossref.PATTERNS):
        before = p.ref.split("$1")[0]
        x = "lower(x)" if p.type == "git_commit" else "x"
        rows.append(f"select id episode_id, {i} i, '{p.type}' \"type\", '{before}' || {x} \"ref\", {p.confidence}::double confidence from (select id, unnest(regexp_extract_all(content, '{p.regex}', 1)) x from epi where content is not null)")
    return "rf0 as (" + " union all ".join(rows) + '), rf as (select episode_id, "type", "ref", arg_min(confidence, i) confidence from rf0 group by 1, 2, 3)'


_PRIM = "pe as (select episode_id, entity_id from (select episode_id, entity_id, row_number() over (partition by episode_id order by max(confidence) desc, entity_id) r from evi group by 1, 2) where r = 1)"
_RES = """tk as (select source_type || '|' || source_ref as key, * from epi where status <> 'redacted' and source_ref is not null union all
  select 'github_issue|#' || coalesce(nullif(regexp_extract(source_ref, '/issues/([0-9]+)$', 1), ''), nullif(regexp_extract(source_ref, '/pull/([0-9]+)$', 1), '')), * from epi where status <> 'redacted' and source_type in ('github_issue', 'github_pr') and source_ref is not null),
tb as (select key, id target_episode from (select key, id, row_number() over (partition by key order by (superseded_by is null) desc, timestamp desc, id desc) r from tk where key is not null) where r = 1),
rs as (select rf.*, target_episode, pe.entity_id target_entity from rf left join tb on tb.key = rf."type" || '|' || rf."ref" left join pe on pe.episode_id = target_episode)"""
_XREF = ", ".join((_pattern_sql(), _PRIM, _RES))
query("D22_references", 'select episode_id, "type", "ref", confidence from rf', _XREF)(lambda g: crossref.references(g.episodes))
query("W3_primary_entity", "select * from pe", _PRIM)(crossref.primary_entities)
query("D22_J13_resolved", 'select episode_id, "type", "ref", target_episode, target_entity from rs where target_episode is not null', _XREF)(lambda g: crossref.resolved(g, crossref.references(g.episodes)).filter("target_episode is not null").select("episode_id", "type", "ref", "target_episode", "target_entity"))
query("D23_reference_edges", "select pe.entity_id as source_entity, target_entity, count(distinct rs.episode_id) as n_episodes, max(confidence) as confidence from rs join pe on pe.episode_id = rs.episode_id where target_entity is not null and target_episode <> rs.episode_id and pe.entity_id <> target_entity group by 1, 2", _XREF)(lambda g: crossref.reference_edges(g, crossref.references(g.episodes)))
query("D24_unresolved", 'select "type", count(*) as n from rs where target_episode is null group by 1', _XREF)(lambda g: crossref.unresolved(g, crossref.references(g.episodes)).groupBy("type").agg(F.count(F.lit(1)).alias("n")))

# derived documents

_PAGES = """pg as (select 'page:' || id projection_id, id entity_id, created_at + interval 365 day as_of from ent where entity_type = 'module'),
inp as (select projection_id, 'entity' target_type, entity_id target_id from pg
  union select projection_id, 'episode', ev.episode_id from pg join ev using (entity_id) join epi p on p.id = ev.episode_id where p.ingested_at <= as_of
  union select projection_id, 'edge', t.id from pg join tou t using (entity_id) where t.created_at <= as_of and (t.invalidated_at is null or t.invalidated_at > as_of)),
hs as (select 'entity' target_type, id target_id, sha256(concat_ws(': ', canonical_name, nullif(summary, ''))) sh, case when status = 'active' then sha256(concat_ws(': ', canonical_name, nullif(summary, ''))) end ch from ent
  union all select 'episode', id, content_hash, case when status <> 'redacted' then content_hash end from epi
  union all select 'edge', id, sha256(fact), case when invalidated_at is null then sha256(fact) end from edg),
ih as (select inp.*, sh, ch from inp left join hs using (target_type, target_id))"""
_pages = lambda g: projections.default_inputs(g, projections.module_pages(g))
query("P7_default_inputs", "select * from inp", _PAGES)(_pages)
query("P1_P9_input_state", "select projection_id, target_type, target_id, ch as hash from ih", _PAGES)(lambda g: _pages(g).join(projections.current_hashes(g), ["target_type", "target_id"], "left").select("projection_id", "target_type", "target_id", "hash"))
query("P2_fingerprint", "select projection_id, sha256(string_agg(target_type || ':' || target_id || ':' || coalesce(sh, ''), chr(10) order by target_type || ':' || target_id || ':' || coalesce(sh, ''))) as fingerprint from ih group by 1", _PAGES)(lambda g: projections.fingerprint(projections.stored(g, _pages(g)), "stored_hash"))
_STALE = ", st as (select projection_id, count(*) filter (where ch is null and sh is not null) n_deleted, count(*) filter (where ch is not null and ch <> coalesce(sh, '')) n_changed from ih group by 1)"
query("P4_P5_staleness", "select projection_id, n_deleted + n_changed > 0 as stale, case when n_deleted > 0 then 'input_deleted' when n_changed > 0 then 'input_content_changed' end as reason, n_deleted, n_changed from st", _PAGES + _STALE)(lambda g: projections.staleness(g, projections.stored(g, _pages(g))))
query("P6_active_pages", "select pg.projection_id, e.canonical_name as title, n_deleted + n_changed > 0 as stale from pg join ent e on e.id = entity_id join st using (projection_id)", _PAGES + _STALE)(
    lambda g: projections.module_pages(g).join(g.entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("title")), "entity_id").join(projections.staleness(g, projections.stored(g, _pages(g))).select("projection_id", "stale"), "projection_id").select("projection_id", "title", "stale")
)
query("P8_refreshed_fingerprint", "select projection_id, sha256(string_agg(target_type || ':' || target_id || ':' || coalesce(ch, ''), chr(10) order by target_type || ':' || target_id || ':' || coalesce(ch, ''))) as fingerprint from ih group by 1", _PAGES)(lambda g: projections.fingerprint(_pages(g).join(projections.current_hashes(g), ["target_type", "target_id"], "left"), "hash"))
_SINCE = "2024-01-01 00:00:00"
_DELTA = f"dl as (select 'episode' item, id, ingested_at \"at\", substr(content, 1, 200) summary from epi where ingested_at > timestamp '{_SINCE}' union all select 'entity', id, created_at, substr(canonical_name, 1, 200) from ent where created_at > timestamp '{_SINCE}' union all select 'edge', id, created_at, substr(fact, 1, 200) from edg where created_at > timestamp '{_SINCE}' and invalidated_at is null)"
query("P12_delta", "select * from dl", _DELTA)(lambda g: projections.delta(g, _SINCE))
query("W10_sampled_delta", "select item, id from (select item, id, row_number() over (partition by item order by \"at\" desc, id desc) r, count(*) over (partition by item) n, count(*) over () t from dl) where r <= case when t <= 500 then n else greatest(1, floor(500.0 * n / t + 0.5)) end", _DELTA)(lambda g: projections.sampled_delta(g, _SINCE))

# digests

query(
    "A22_tenure",
    'select entity_id, min(timestamp) as "first", max(timestamp) as "last" from (select entity_id, timestamp from lev where entity_id in (select id from ent where entity_type = \'person\') union all select e.id, p.timestamp from ent e join epi p on p.actor = e.canonical_name where e.entity_type = \'person\' and p.status <> \'redacted\') group by 1',
)(digest.tenure)
query("A23_area_people", f"select source_id as \"owner\", round(sum(round(case when {days_sql(NOW_SQL, 'valid_from')} > 90 then 0.5 else 1.0 end * confidence, 6)), 2) as score from edg where invalidated_at is null and relation_type = 'likely_owner_of' and target_id in (select id from ent where starts_with(canonical_name, 'ingest/')) and source_id in (select id from ent where entity_type = 'person') group by 1")(lambda g: digest.area_people(g, "ingest"))
_TOP = "tc5 as (select entity_id, other, weight from (select entity_id, case when source_id = entity_id then target_id else source_id end other, weight, row_number() over (partition by entity_id order by weight desc nulls last, id) r from tou where invalidated_at is null and relation_type = 'co_changes_with' and source_id <> target_id) where r <= 5)"
query("A24_hot_files", "select id, cast(sum(heat) as bigint) as heat from (select other id, sum(floor(coalesce(weight, 1.0) + 0.5)) heat from tc5 where entity_id in (select id from ent where starts_with(canonical_name, 'ingest/')) group by 1 union all select id, 1 from ent where starts_with(canonical_name, 'ingest/')) group by 1", _TOP)(lambda g: digest.hot_files(g, "ingest"))
_COL = "cl as (select a.source_id a, b.source_id b, count(*) shared from (select distinct source_id, target_id from edg where invalidated_at is null and relation_type = 'likely_owner_of') a join (select distinct source_id, target_id from edg where invalidated_at is null and relation_type = 'likely_owner_of') b using (target_id) where a.source_id <> b.source_id group by 1, 2)"
query("A25_collaborators", "select * from cl", _COL)(digest.collaborators)
_FILE = "(select min(canonical_name) from ent where entity_type = 'file')"
query(
    "N1_why",
    "select * from (select 'introduced' as section, id from ep where source_type = 'git_commit' order by timestamp, id limit 1) union all select * from (select 'pull_request', id from ep where source_type = 'github_pr' order by timestamp desc, id limit 10) union all select 'co_change', other from tc5 where entity_id in (select id from who) union all select 'owner', \"owner\" from so where entity_id in (select id from who)",
    _TOP + "," + _CTES.rstrip() + f", who as (select id from ent where canonical_name = {_FILE}), ep as (select p.id, p.source_type, p.timestamp from lev join epi p on p.id = lev.episode_id where lev.entity_id in (select id from who))",
)(lambda g: digest.why(g, g.entities.filter("entity_type = 'file'").agg(F.min("canonical_name")).first()[0]))
query(
    "N3_brief",
    "select 'entity' as section, entity_id as id from ins union all select distinct 'owner', \"owner\" from so where entity_id in (select entity_id from ins) union all select distinct 'outside', other from tc5 where entity_id in (select entity_id from ins) and other not in (select entity_id from ins)",
    _TOP + "," + _CTES.rstrip() + ", ins as (select distinct entity_id from ev where episode_id = (select min(id) from epi where source_type = 'github_pr' and id in (select episode_id from ev)))",
)(lambda g: digest.brief(g, g.episodes.filter("source_type = 'github_pr'").select("id").join(g.entity_evidence.select(F.col("episode_id").alias("id")), "id", "left_semi").agg(F.min("id")).first()[0]))
_PERSON = "(select min(canonical_name) from ent where entity_type = 'person')"
query(
    "N7_person",
    "select 'owns' as section, target_id as id, round(confidence, 6) as value from edg where invalidated_at is null and relation_type = 'likely_owner_of' and source_id in (select id from who) union all select 'reviewed', source_id, round(confidence, 6) from edg where invalidated_at is null and relation_type = 'reviewed_by' and target_id in (select id from who) union all select 'shares', b, shared::double from cl where a in (select id from who)",
    _COL + f", who as (select id from ent where entity_type = 'person' and canonical_name = {_PERSON})",
)(lambda g: digest.person(g, g.entities.filter("entity_type = 'person'").agg(F.min("canonical_name")).first()[0]))
_QUESTION = "Which lattice ownership edge touches the fingerprint snapshot?"
_TERMS = [[t] for t in topic_terms(_QUESTION)]
query(
    "V20_W8_context",
    "select section, id, tokens, used from (select *, cast(sum(tokens) over (partition by side order by k, \"rank\", id rows unbounded preceding) as bigint) used from cand) where used <= case side when 0 then 1300 else 700 end",
    fts("fe", "ent", E_TEXT, _TERMS, True)
    + ", "
    + fts("fd", "edg", "fact", _TERMS, True)
    + ", "
    + fts("fc", "epi", "content", _TERMS, True)
    + f""", cand as (select 'entity' section, 0 side, 0 k, id, "rank", cast(ceil(length({E_TEXT}) / 4.0) as bigint) tokens from (select * from fe where id in (select id from ent where status = 'active') order by "rank", id limit 30) join ent using (id)
union all select 'edge', 0, 1, id, "rank", cast(ceil(length(fact) / 4.0) as bigint) from (select * from fd where id in (select id from edg where invalidated_at is null) order by "rank", id limit 20) join edg using (id)
union all select 'discussion', 1, 2, id, "rank", cast(ceil(length(substr(trim(content), 1, case source_type when 'github_pr' then 1200 when 'github_issue' then 1000 when 'git_commit' then 600 else 800 end)) / 4.0) as bigint) from (select fc.id, "rank" from fc join epi using (id) where status = 'active' order by case source_type when 'github_pr' then 0 when 'github_issue' then 1 when 'git_commit' then 2 else 3 end, "rank", fc.id limit 20) join epi using (id))""",
)(lambda g: digest.context(g, _QUESTION, budget=2000))
query("V18_structural_edges", "select id, case relation_type when 'co_changes_with' then 0.8 when 'likely_owner_of' then 0.7 when 'supersedes' then 0.75 else 0.5 end::double as score from edg where invalidated_at is null and relation_type <> 'authored_by' and (source_id in (select id from ent where entity_type = 'service') or target_id in (select id from ent where entity_type = 'service'))")(
    lambda g: g.touching.filter("invalidated_at is null and relation_type <> 'authored_by'").join(g.entities.filter("entity_type = 'service'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", F.when(F.col("relation_type") == "co_changes_with", 0.8).when(F.col("relation_type") == "likely_owner_of", 0.7).when(F.col("relation_type") == "supersedes", 0.75).otherwise(0.5).alias("score")).distinct()
)
query("N4_issue_links", "select i.id as issue, p.id as pull_request from (select id, split_part(source_ref, '/', -1) n from epi where source_type = 'github_issue' and source_ref like '%/issues/%') i join (select episode_id id, \"ref\" from rf where \"type\" = 'github_issue') l on l.\"ref\" = '#' || i.n join epi p on p.id = l.id where p.source_type = 'github_pr'", _pattern_sql())(
    lambda g: g.episodes.filter("source_type = 'github_issue' and source_ref like '%/issues/%'")
    .select(F.col("id").alias("issue"), F.concat(F.lit("#"), F.element_at(F.split("source_ref", "/"), -1)).alias("ref"))
    .join(crossref.references(g.episodes).filter("type = 'github_issue'").select(F.col("episode_id").alias("pull_request"), "ref"), "ref")
    .join(g.episodes.filter("source_type = 'github_pr'").select(F.col("id").alias("pull_request")), "pull_request", "left_semi")
    .select("issue", "pull_request")
)
