"""References to records that are absent, or that came later, and what hangs below them.

Direct orphans are found by anti-joins from cleaned ids. The cascade then follows the foreign-key graph: a record that
refers to an orphaned record is an inherited orphan one level deeper. Where each record refers to one record at most, the fixpoint is
reached by doubling the references, in rounds that grow with the logarithm of the depth; else by semi-joins, a level a round.

Cleaned id: trimmed of spaces and upper-cased; null and empty are no reference. Repeated rows are one record. Rows without an
own id are no records and cannot be reported. A loop of references ends the cascade, as each record enters it once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cut, new_path
from .skew import HOT_ROWS, hot_keys, salted_join


@dataclass(frozen=True)
class ForeignKey:
    """column of table refers to parent; late: also report parents that came after the referring row."""

    table: str
    column: str
    parent: str
    late: bool = True


@dataclass(frozen=True)
class Table:
    """A table of records and the column that tells when a record came."""

    df: DataFrame
    id: str = "id"
    born: str = "created_at"


def cleaned(column: str | Column) -> Column:
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def references(tables: dict[str, Table], keys: list[ForeignKey], parents: list[str]) -> DataFrame:
    """One narrow row for each reference that is one: (fk: place in keys, row_id, ref_key, born)."""
    out = None
    for table in dict.fromkeys(k.table for k in keys):
        t = tables[table]
        # one scan for all reference columns of a table
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("fk"), cleaned(k.column).alias("ref"), F.lit(f"{parents.index(k.parent)}|").alias("p")) for i, k in enumerate(keys) if k.table == table]))
        rows = t.df.filter(F.col(t.id).isNotNull()).select(F.col(t.id).alias("row_id"), F.col(t.born).alias("born"), pairs.alias("x"))
        rows = rows.filter("x.ref <> ''").select("x.fk", "row_id", F.concat("x.p", "x.ref").alias("ref_key"), "born")
        out = rows if out is None else out.unionByName(rows)
    return out


def records(tables: dict[str, Table], parents: list[str]) -> DataFrame:
    """(parent_key, born_there): each record once, with the earliest time it is known to have come."""
    out = None
    for i, name in enumerate(parents):
        t = tables[name]
        rows = t.df.filter(cleaned(t.id) != "").select(F.concat(F.lit(f"{i}|"), cleaned(t.id)).alias("parent_key"), F.col(t.born).alias("born_there"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("parent_key").agg(F.min("born_there").alias("born_there"), F.lit(True).alias("there"))


def orphans(tables: dict[str, Table], keys: list[ForeignKey], cascade: bool = True, max_levels: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(ref_table, ref_column, row_id, born, ref_state, level): level 0 direct ('missing' or 'late'), above it 'inherited'.

    A record is orphaned through a missing reference; 'late' rows are reported but pass nothing on. Each reference of a row
    is reported at most once, at its first level.
    """
    parents = list(dict.fromkeys(k.parent for k in keys))
    refs = references(tables, keys, parents)
    joined = salted_join(refs, records(tables, parents), "ref_key", "parent_key", "left", hot_rows=hot_rows)
    watch = F.col("fk").isin([i for i, k in enumerate(keys) if k.late])
    state = F.when(F.col("there").isNull(), "missing").when(watch & (F.col("born_there") > F.col("born")), "late")
    direct = joined.withColumn("ref_state", state).filter("ref_state is not null").select("fk", "row_id", "born", "ref_state", F.lit(0).alias("level")).distinct()
    if not cascade:
        return _named(direct, keys)
    found = Cut(direct, "orphans").df
    # only a table that is referred to can pass its orphans on
    inner = sorted({k.table for k in keys} & set(parents))
    own = [i for i, k in enumerate(keys) if k.parent in inner]
    if not own:
        return _named(found, keys)
    place = F.create_map(*[x for i, k in enumerate(keys) if k.table in inner for x in (F.lit(i), F.lit(f"{parents.index(k.table)}|"))])
    links = refs.filter(F.col("fk").isin(own)).distinct().withColumn("child", F.concat(place[F.col("fk")], cleaned("row_id")))
    links = Cut(links, "links").df
    seeds = Cut(found.filter("ref_state = 'missing'").select(F.concat(place[F.col("fk")], cleaned("row_id")).alias("gone")).filter("gone is not null").distinct(), "seeds").df
    one_each = links.filter("child is not null").groupBy("child").agg(F.countDistinct("ref_key").alias("n")).filter("n > 1").isEmpty()
    levels = (_doubled if one_each else _round_by_round)(links, seeds, hot_rows)
    if max_levels is not None:
        levels = levels.filter(F.col("level") <= max_levels)
    parts = found.unionByName(levels.select("fk", "row_id", "born", F.lit("inherited").alias("ref_state"), "level"))
    # a reference found missing or late stays what it is
    first = parts.groupBy("fk", "row_id", "born").agg(F.min(F.struct("level", "ref_state")).alias("s"))
    return _named(first.select("fk", "row_id", "born", "s.ref_state", "s.level"), keys)


def _doubled(links: DataFrame, seeds: DataFrame, hot_rows: int) -> DataFrame:
    """(fk, row_id, born, level) where each record refers to one record at most: pointer doubling, so rounds grow with the
    logarithm of the depth.

    (child, up, steps, level): up is `steps` references above; level is the number of steps to the first orphan, once one is known. A
    record is settled with it, or when its up refers to nothing. As a chain longer than 2**k steps has records of every smaller distance, a round
    that settles none leaves only loops, which hold no orphan.
    """
    marked = seeds.withColumn("hit", F.lit(1))
    walk = salted_join(links.filter("child is not null").select("child", F.col("ref_key").alias("up")).distinct(), marked, "up", "gone", "left", hot_rows=hot_rows)
    walk = Cut(walk.select("child", "up", F.lit(1).cast("int").alias("steps"), F.col("hit").alias("level"), F.col("hit").isNotNull().alias("done")), "walk")
    left = walk.df.filter("not done").count()
    while left:
        above = walk.df.select(F.col("child").alias("c2"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("level").alias("level2"), F.col("done").alias("done2"))
        step = salted_join(walk.df.filter("not done"), above, "up", "c2", "left", hot_rows=hot_rows)
        level = F.when(F.col("level2").isNotNull(), F.col("steps") + F.col("level2"))
        ended = F.coalesce(F.col("done2"), F.lit(True))
        step = step.select("child", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), level.alias("level"), ended.alias("done"))
        grown = Cut(walk.df.filter("done").unionByName(step), "walk")
        walk.drop()
        walk, before = grown, left
        left = walk.df.filter("not done").count()
        if left == before:
            break
    hit = walk.df.filter("level is not null").select(F.col("child").alias("c"), "level")
    inner = links.filter("child is not null").join(hit, F.col("child") == F.col("c")).select("fk", "row_id", "born", "level")
    # a record that nothing can refer to only takes over from its parent
    known = seeds.select(F.col("gone").alias("c"), F.lit(0).alias("d")).unionByName(hit.select("c", F.col("level").alias("d"))).groupBy("c").agg(F.min("d").alias("d"))
    outer = salted_join(links.filter("child is null"), known, "ref_key", "c", "inner", hot_rows=hot_rows)
    return inner.unionByName(outer.select("fk", "row_id", "born", (F.col("d") + 1).alias("level")))


def _round_by_round(links: DataFrame, seeds: DataFrame, hot_rows: int) -> DataFrame:
    """The same where records refer to several: one round of semi-joins for each level, until one adds nothing."""
    # all levels lie in one folder, so that however deep the cascade runs, each round's plan reads two tables
    spark = links.sparkSession
    path, shape = new_path(spark, "levels"), "fk int, row_id string, born timestamp_ntz"
    shape = shape.replace("timestamp_ntz", dict(links.dtypes)["born"])
    hot = hot_keys(links, "ref_key", hot_rows)
    seeds.write.parquet(f"{path}-gone/level=0")
    level = 0
    while True:
        level += 1
        fresh = spark.read.schema("gone string").parquet(f"{path}-gone/level={level - 1}")
        hit = salted_join(links, fresh, "ref_key", "gone", "left_semi", hot=hot)
        if level > 1:  # in a loop of references each one is met once
            hit = hit.join(spark.read.schema(f"{shape}, level int").parquet(path).select("fk", "row_id"), ["fk", "row_id"], "left_anti")
        hit = Cut(hit, "hit").df
        hit.select("fk", "row_id", "born").write.parquet(f"{path}/level={level}")
        if hit.isEmpty():
            return spark.read.schema(f"{shape}, level int").parquet(path)
        hit.select(F.col("child").alias("gone")).filter("gone is not null").distinct().write.parquet(f"{path}-gone/level={level}")


def _named(found: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    name = lambda f: F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(i), F.lit(f(k)))])[F.col("fk")]
    return found.select(name(lambda k: k.table).alias("ref_table"), name(lambda k: k.column).alias("ref_column"), "row_id", "born", "ref_state", "level")
