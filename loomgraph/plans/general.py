"""Queries over the general problems: intervals, orphans, hierarchies and as-known attributes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import as_known
from ..operators.hierarchy import hierarchy, links_of, paths, walk_down
from ..operators.intervals import coverage, micros
from ..operators.orphans import ForeignKey, Table, cleaned, orphans
from ..session import Cut, load

KEYS = ["ref_table", "subject_id", "object_key", "relation_type"]


def validity_windows(spark: SparkSession, d: str) -> DataFrame:
    bounds = [micros("valid_from").alias("s"), micros("valid_until").alias("e")]
    edges = load(spark, d, "edges").select(F.lit("edges").alias("ref_table"), F.col("source_id").alias("subject_id"), F.col("target_id").alias("object_key"), "relation_type", *bounds)
    aliases = load(spark, d, "entity_aliases").select(F.lit("entity_aliases").alias("ref_table"), F.col("entity_id").alias("subject_id"), F.col("alias").alias("object_key"), F.lit("alias").alias("relation_type"), *bounds)
    return edges.unionByName(aliases)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = coverage(validity_windows(spark, d), KEYS, "s", "e", gaps_only=True).filter("kind = 'gap'")
    return gaps.select(*KEYS, F.col("from_us").alias("gap_from_us"), F.col("until_us").alias("gap_until_us"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return coverage(validity_windows(spark, d), KEYS, "s", "e").filter("kind = 'period'").select(*KEYS, "from_us", "until_us")


_WINDOWS = """
with w as (
  select 'edges' ref_table, source_id subject_id, target_id object_key, relation_type, coalesce(epoch_us(valid_from), -9223372036854775807) s, coalesce(epoch_us(valid_until), 9223372036854775807) e from edges
  union all
  select 'entity_aliases', entity_id, alias, 'alias', coalesce(epoch_us(valid_from), -9223372036854775807), coalesce(epoch_us(valid_until), 9223372036854775807) from entity_aliases),
m as (select *, max(e) over (partition by ref_table, subject_id, object_key, relation_type order by s, e rows between unbounded preceding and 1 preceding) pe from w where e > s)
"""

P1_FOUND = _WINDOWS + "select ref_table, subject_id, object_key, relation_type, pe as gap_from_us, s as gap_until_us from m where s > pe"
P1_PERIODS = (
    _WINDOWS
    + """, g as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by ref_table, subject_id, object_key, relation_type order by s, e rows unbounded preceding) n from m)
select ref_table, subject_id, object_key, relation_type, nullif(min(s), -9223372036854775807) from_us, nullif(max(e), 9223372036854775807) until_us from g group by all, n"""
).replace("group by all, n", "group by ref_table, subject_id, object_key, relation_type, n")

FOREIGN_KEYS = [
    ForeignKey("edges", "source_id", "entities"),
    ForeignKey("edges", "target_id", "entities"),
    ForeignKey("edges", "superseded_by", "edges", late=False),
    ForeignKey("entity_aliases", "episode_id", "episodes"),
]


def reference_orphans(spark: SparkSession, d: str, cascade: bool = True) -> DataFrame:
    tables = {
        "edges": Table(load(spark, d, "edges")),
        "entities": Table(load(spark, d, "entities")),
        "entity_aliases": Table(load(spark, d, "entity_aliases")),
        "episodes": Table(load(spark, d, "episodes"), born="ingested_at"),
    }
    return orphans(tables, FOREIGN_KEYS, cascade)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Direct orphans only; p5_report has the inherited ones too."""
    return reference_orphans(spark, d, cascade=False).select("ref_table", "ref_column", "row_id", "ref_state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("born", "yyyy-MM").alias("month")
    return reference_orphans(spark, d).groupBy("ref_table", "ref_column", month, "ref_state", "level").agg(F.count(F.lit(1)).alias("n_refs"))


_REFS = """
with recursive refs as (
  select distinct 'edges' ref_table, 'source_id' ref_column, 'entities' parent, id row_id, upper(trim(source_id)) ref, created_at born, true watch from edges
  union select 'edges', 'target_id', 'entities', id, upper(trim(target_id)), created_at, true from edges
  union select 'edges', 'superseded_by', 'edges', id, upper(trim(superseded_by)), created_at, false from edges
  union select 'entity_aliases', 'episode_id', 'episodes', id, upper(trim(episode_id)), created_at, true from entity_aliases),
recs as (
  select 'entities' parent, upper(trim(id)) ref, min(created_at) born_there from entities group by 2
  union all select 'edges', upper(trim(id)), min(created_at) from edges group by 2
  union all select 'episodes', upper(trim(id)), min(ingested_at) from episodes group by 2),
direct as (
  select ref_table, ref_column, row_id, born, case when r.ref is null then 'missing' else 'late' end ref_state
  from refs f left join recs r using (parent, ref) where f.ref <> '' and (r.ref is null or (watch and born_there > born)))
"""
P5_FOUND = _REFS + "select ref_table, ref_column, row_id, ref_state from direct"
P5_REPORT = (
    _REFS
    + """, down as (
  select upper(trim(row_id)) id, 0 lvl from direct where ref_table = 'edges' and ref_state = 'missing'
  union select upper(trim(f.row_id)), lvl + 1 from refs f join down on f.ref_column = 'superseded_by' and f.ref = down.id where lvl < 200),
inh as (select f.ref_table, f.ref_column, f.row_id, f.born, min(lvl) + 1 lvl from refs f join down on f.ref_column = 'superseded_by' and f.ref = down.id group by all)
select ref_table, ref_column, strftime(born, '%Y-%m') as month, ref_state, cast(lvl as int) as level, count(*) as n_refs
from (select ref_table, ref_column, row_id, born, ref_state, 0 lvl from direct union all select ref_table, ref_column, row_id, born, 'inherited', lvl from inh) group by all"""
)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    edges = load(spark, d, "edges").select("id", "superseded_by")
    tree = hierarchy(edges, "id", "superseded_by")
    asked = edges.filter((cleaned("superseded_by") != "") & F.col("id").isNotNull()).select(F.col("id").alias("edge_id"), cleaned("id").alias("key")).distinct()
    sound = asked.join(tree.nodes.select(F.col("id").alias("key"), "root_id", "depth"), "key")
    looped = asked.join(tree.loops.select(F.col("id").alias("key"), "root_id"), "key").withColumn("depth", F.lit(-1).cast("long"))
    return sound.unionByName(looped).select("edge_id", "root_id", "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every edge: its final edge, depth, path from that edge down to it, and how many edges it ends up replacing; loops have depth -1 and no path."""
    edges = load(spark, d, "edges").select("id", "superseded_by")
    tree = hierarchy(edges, "id", "superseded_by")
    linked = paths(tree).select(F.col("id").alias("edge_id"), "root_id", "depth", "n_descendants", F.array_join("path", ">").alias("path"))
    looped = tree.loops.select(F.col("id").alias("edge_id"), "root_id", F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("n_descendants"), F.lit(None).cast("string").alias("path"))
    both = linked.unionByName(looped)
    single = edges.filter(cleaned("id") != "").select(cleaned("id").alias("edge_id")).distinct().join(both.select("edge_id"), "edge_id", "left_anti")
    return both.unionByName(single.select("edge_id", F.col("edge_id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_descendants"), F.col("edge_id").alias("path")))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every edge with each edge it ends up replacing; in and below loops too, where an edge is not said to replace itself."""
    edges = load(spark, d, "edges").select("id", "superseded_by")
    tree = hierarchy(edges, "id", "superseded_by")
    below = walk_down(tree, tree.nodes.select("id")).select(F.col("ancestor").alias("edge_id"), F.col("descendant").alias("replaced_id"))
    # the closure of what leads into loops, by doubling
    near = Cut(links_of(edges, "id", "superseded_by")[0].join(tree.loops.select("id"), "id").select(F.col("parent").alias("edge_id"), F.col("id").alias("replaced_id")), "closure").df
    n, before = near.count(), 0
    while n > before:
        near = Cut(near.union(near.join(near.select(F.col("replaced_id").alias("edge_id"), F.col("edge_id").alias("above")), "edge_id").select(F.col("above").alias("edge_id"), "replaced_id")).distinct(), "closure").df
        n, before = near.count(), n
    return below.unionByName(near.filter("edge_id <> replaced_id"))


_LINKS = """
with recursive given as (select upper(trim(id)) id, max(upper(trim(superseded_by))) p from edges where trim(superseded_by) <> '' group by 1),
ids as (select distinct upper(trim(id)) id from edges),
links as (select given.id, p from given join ids on ids.id = p),
walk as (select id, id cur, 0 d from ids where {seed} union select walk.id, links.p, d + 1 from walk join links on links.id = walk.cur where d < 300),
ends as (select id, max(d) d from walk group by id)
"""
P6_FOUND = (
    _LINKS.format(seed="id in (select id from given)")
    + """select ends.id as edge_id, case when ends.d >= 300 then (select min(w.cur) from walk w where w.id = ends.id and w.d >= 150) else walk.cur end as root_id, cast(case when ends.d >= 300 then -1 else ends.d end as bigint) as depth
from ends join walk on walk.id = ends.id and walk.d = ends.d"""
)
P6_PATHS = (
    _LINKS.format(seed="true")
    + """, below as (select cur id, count(*) - 1 n from walk join ends e on e.id = walk.id where e.d < 300 group by cur),
loopy as (select id from ends where d >= 300)
select e.id as edge_id, case when e.d >= 300 then (select min(w.cur) from walk w where w.id = e.id and w.d >= 150) else (select w.cur from walk w where w.id = e.id and w.d = e.d) end as root_id,
  cast(case when e.d >= 300 then -1 else e.d end as bigint) as depth, case when e.d >= 300 then null else coalesce(b.n, 0) end as n_descendants,
  case when e.d >= 300 then null else (select string_agg(w.cur, '>' order by w.d desc) from walk w where w.id = e.id) end as path
from ends e left join below b on b.id = e.id"""
)

P6_DESCENDANTS = """
with recursive given as (select upper(trim(id)) id, max(upper(trim(superseded_by))) p from edges where trim(superseded_by) <> '' group by 1),
links as (select id, p from given where p in (select upper(trim(id)) from edges)),
walk as (select id, p cur from links union select walk.id, links.p from walk join links on links.id = walk.cur)
select cur as edge_id, id as replaced_id from walk where id <> cur"""


def _owners(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    episodes = load(spark, d, "episodes").select(F.col("id").alias("episode_id"), "timestamp").distinct()
    pairs = load(spark, d, "entity_evidence").select("entity_id", "episode_id").distinct().join(episodes, "episode_id")
    return pairs, load(spark, d, "edges").filter("relation_type = 'likely_owner_of'").select("id", "target_id", "source_id", "created_at", "invalidated_at", "confidence")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, owners = _owners(spark, d)
    known = as_known(pairs, owners, "entity_id", "timestamp", "target_id", "id", "created_at", "invalidated_at")
    return known.select("episode_id", "entity_id", F.col("_fact").alias("edge_id"))


def p7_owners(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with the wide attributes of the edge, which meet the events last, in one equi-join."""
    pairs, owners = _owners(spark, d)
    known = as_known(pairs, owners, "entity_id", "timestamp", "target_id", "id", "created_at", "invalidated_at")
    wide = owners.select(F.col("id").alias("edge_id"), F.col("source_id").alias("owner"), "confidence").dropDuplicates(["edge_id"])
    return known.withColumnRenamed("_fact", "edge_id").join(wide, "edge_id").select("episode_id", "entity_id", "edge_id", "owner", "confidence")


_KNOWN = """
with pairs as (select distinct v.episode_id, v.entity_id, e.timestamp from entity_evidence v join episodes e on e.id = v.episode_id),
own as (select distinct id, target_id, source_id, confidence, created_at, invalidated_at from edges where relation_type = 'likely_owner_of'),
best as (select p.episode_id, p.entity_id, o.id edge_id, o.source_id owner, o.confidence, row_number() over (partition by p.episode_id, p.entity_id order by o.created_at desc, o.id desc) n
  from pairs p join own o on o.target_id = p.entity_id and o.created_at <= p.timestamp and (o.invalidated_at is null or o.invalidated_at > p.timestamp))
"""
P7_FOUND = _KNOWN + "select episode_id, entity_id, edge_id from best where n = 1"
P7_OWNERS = _KNOWN + "select episode_id, entity_id, edge_id, owner, confidence from best where n = 1"

QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants, "p7_found": p7_found, "p7_owners": p7_owners}
SQL = {"p1_found": P1_FOUND, "p1_periods": P1_PERIODS, "p5_found": P5_FOUND, "p5_report": P5_REPORT, "p6_found": P6_FOUND, "p6_paths": P6_PATHS, "p6_descendants": P6_DESCENDANTS, "p7_found": P7_FOUND, "p7_owners": P7_OWNERS}
