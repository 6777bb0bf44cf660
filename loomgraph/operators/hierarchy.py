"""Parent-child links to full hierarchies by heavy-path decomposition.

Each child has one parent, so the links form trees and loops. Rounds of pointer doubling (each an equi-join) find, in about
log2(depth) rounds, the records that never reach a root: those are in or below a loop. On the rest:

1. subtree sizes, by summing over doubled ancestors;
2. the heavy child of each parent (largest subtree, then smallest id); records linked by heavy links form chains;
3. the head of each chain and the position in it, by doubling over heavy links only;
4. chains are labelled from the root down. A path crosses at most log2(n) chains, so this takes few rounds whatever the depth.

A path is its chain segments one after the other; descendants are the rest of the own chain and the chains that hang from it.

Ids are cleaned (trimmed, upper-cased). A link to an absent record, or an empty one, ends the walk: its child is a root. Rows
repeated whole count once; of several parents given for one child the greatest counts. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Cut
from .orphans import cleaned
from .skew import HOT_ROWS, salted_join

MAX_ROUNDS = 64


@dataclass
class Hierarchy:
    """nodes: (id, parent, root_id, depth, subtree, chain, pos, chain_depth); loops: (id, root_id), root_id the loop's smallest id."""

    nodes: DataFrame
    loops: DataFrame


def links_of(records: DataFrame, id: str, parent: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, parent) of links that lead somewhere, and (id) of all records that give a parent at all."""
    given = records.filter((cleaned(parent) != "") & (cleaned(id) != "")).groupBy(cleaned(id).alias("id")).agg(F.max(cleaned(parent)).alias("parent"))
    given = Cut(given, "links").df
    # the anti-join reads ids only, and only the distinct parents are looked up
    wanted = given.select(F.col("parent").alias("p")).distinct()
    exist = wanted.join(records.select(cleaned(id).alias("rid")), F.col("p") == F.col("rid"), "left_semi")
    return salted_join(given, exist, "parent", "p", "left_semi", hot_rows=hot_rows), given.select("id")


def _loops(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits links into those that reach a root, as (id, parent), and records in or below a loop, as (id, root_id).

    (id, up, low): up is 2**k steps above, low the smallest id met on these steps. A record leaves when its up has no parent.
    As a tree deeper than 2**k has records of every smaller depth, a round in which none leaves proves the rest loops.
    """
    walk = Cut(links.select("id", F.col("parent").alias("up"), F.col("parent").alias("low")), "walk")
    left = walk.df.count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        above = walk.df.select(F.col("id").alias("aid"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        step = salted_join(walk.df, above, "up", "aid", "inner").select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low"))
        grown = Cut(step, "walk")
        now = grown.df.count()
        walk.drop()
        walk = grown
        if now == left:
            break
        left = now
    # The records reached in 2**k steps shrink to those in loops and then stay; low is final once no further doubling moves it.
    reached = walk.df.select("up").distinct().count() if left else 0
    while left:
        above = walk.df.select(F.col("id").alias("aid"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        step = salted_join(walk.df, above, "up", "aid", "inner").select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        grown = Cut(step, "walk")
        moved, now = grown.df.agg(F.max("moved"), F.countDistinct("up")).first()
        walk = grown
        if not moved and now == reached:
            break
        reached = now
    # below a loop, low may be an id on the way to it; the smallest id of the loop itself is what records in the loop see
    met = walk.df.select("id", "up", "low")
    loops = salted_join(met.select("id", "up"), met.select(F.col("id").alias("lid"), F.col("low").alias("root_id")), "up", "lid", "inner").select("id", "root_id")
    return links.join(loops.select("id"), "id", "left_anti"), loops


def hierarchy(records: DataFrame, id: str, parent: str, hot_rows: int = HOT_ROWS) -> Hierarchy:
    linked, given = links_of(records, id, parent, hot_rows)
    linked = Cut(linked, "linked").df
    sound, loops = _loops(linked)
    loops, sound = Cut(loops, "loops").df, Cut(sound, "sound").df

    # 1. subtree sizes: size(v) sums the sizes, so far, of the records 2**k below v
    size = Cut(sound.select("id").union(sound.select("parent")).union(given.join(loops.select("id"), "id", "left_anti")).distinct().select("id", F.lit(1).cast("long").alias("size")), "size")
    up = Cut(sound.select("id", F.col("parent").alias("up")), "up")
    while not up.df.isEmpty():
        below = up.df.join(size.df, "id").groupBy(F.col("up").alias("uid")).agg(F.sum("size").alias("more"))
        grown = Cut(size.df.join(below, F.col("id") == F.col("uid"), "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "size")
        next_up = Cut(salted_join(up.df, up.df.select(F.col("id").alias("aid"), F.col("up").alias("up2")), "up", "aid", "inner", hot_rows=hot_rows).select("id", F.col("up2").alias("up")), "up")
        size.drop()
        up.drop()
        size, up = grown, next_up

    # 2. heavy links: the greatest size, then the smallest id
    sized = sound.join(size.df, "id")
    heavy = sized.groupBy("parent").agg(F.max("size").alias("most")).withColumnRenamed("parent", "hp")
    at_most = salted_join(sized, heavy, "parent", "hp", "inner", hot_rows=hot_rows).filter("size = most")
    chosen = at_most.groupBy("parent").agg(F.min("id").alias("id"))

    # 3. chain heads: (id, up, steps); up moves along heavy links and stays once there is none
    jump = Cut(size.df.join(chosen, "id", "left").select("id", F.coalesce("parent", "id").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps")), "jump")
    while True:
        above = jump.df.select(F.col("id").alias("aid"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        grown = Cut(salted_join(jump.df, above, "up", "aid", "inner", hot_rows=hot_rows).select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "jump")
        moved = grown.df.filter("moved").limit(1).count()
        jump.drop()
        jump = grown
        if not moved:
            break
    chains = jump.df.select("id", F.col("up").alias("chain"), F.col("steps").alias("pos"))

    # 4. chains from the root down: a head's parent tells the chain it hangs from and where
    base = chains.join(sound, "id", "left").join(size.df, "id").select("id", "parent", "chain", "pos", F.col("size").alias("subtree"))
    base = Cut(base, "base").df
    heads = base.filter("id = chain").select("chain", "parent")
    hung = salted_join(heads.filter("parent is not null"), base.select(F.col("id").alias("pid"), F.col("chain").alias("over"), F.col("pos").alias("over_pos")), "parent", "pid", "inner", hot_rows=hot_rows).select("chain", "over", "over_pos")
    hung = Cut(hung, "hung").df
    done = Cut(heads.filter("parent is null").select("chain", F.col("chain").alias("root_id"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("chain_depth")), "labels")
    labels, fresh = done.df, done.df
    while True:
        top = fresh.select(F.col("chain").alias("tc"), "root_id", "at", "chain_depth")
        grown = Cut(salted_join(hung, top, "over", "tc", "inner", hot_rows=hot_rows).select("chain", "root_id", (F.col("at") + F.col("over_pos") + 1).alias("at"), (F.col("chain_depth") + 1).alias("chain_depth")), "labels")
        if grown.df.isEmpty():
            break
        labels, fresh = labels.unionByName(grown.df), grown.df
    nodes = salted_join(base, labels.withColumnRenamed("chain", "lc"), "chain", "lc", "inner", hot_rows=hot_rows)
    nodes = nodes.select("id", "parent", "root_id", (F.col("at") + F.col("pos")).alias("depth"), "subtree", "chain", "pos", "chain_depth")
    return Hierarchy(Cut(nodes, "nodes").df, loops)


def paths(tree: Hierarchy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root_id, depth, n_descendants, path): path holds the ids from the root down to the record.

    Each chain is held once as an ordered array; a record's path is the segments of the chains above it, cut where the next
    one hangs, and its own chain down to its position. Chain prefixes are made once for each chain, not for each record.
    """
    nodes = tree.nodes
    whole = Cut(nodes.groupBy("chain").agg(F.expr("transform(array_sort(collect_list(struct(pos, id))), x -> x.id)").alias("ids")), "chains").df
    heads = nodes.filter("id = chain").select("chain", "parent", "chain_depth")
    hung = salted_join(heads.filter("parent is not null"), nodes.select(F.col("id").alias("pid"), F.col("chain").alias("over"), F.col("pos").alias("over_pos")), "parent", "pid", "inner", hot_rows=hot_rows).select("chain", "over", "over_pos", "chain_depth")
    hung = Cut(hung, "hung").df
    prefix = heads.filter("parent is null").select("chain", F.array().cast("array<string>").alias("prefix"))
    fresh, depth = prefix, 0
    while True:
        depth += 1
        now = hung.filter(F.col("chain_depth") == depth)
        if now.isEmpty():
            break
        over = fresh.join(whole, "chain").select(F.col("chain").alias("oc"), "prefix", "ids")
        made = salted_join(now, over, "over", "oc", "inner", hot_rows=hot_rows).select("chain", F.concat("prefix", F.slice("ids", 1, (F.col("over_pos") + 1).cast("int"))).alias("prefix"))
        fresh = Cut(made, "prefix").df
        prefix = prefix.unionByName(fresh)
    full = prefix.join(whole, "chain").select(F.col("chain").alias("pc"), "prefix", "ids")
    out = salted_join(nodes, full, "chain", "pc", "inner", hot_rows=hot_rows)
    return out.select("id", "root_id", "depth", (F.col("subtree") - 1).alias("n_descendants"), F.concat("prefix", F.slice("ids", 1, (F.col("pos") + 1).cast("int"))).alias("path"))


def descendants(tree: Hierarchy) -> DataFrame:
    """(chain, pos_from, pos_to, over_chain, over_pos): what hangs where, as chain intervals instead of ancestor-descendant pairs.

    The descendants of a record at (chain c, position p) are the members of c behind p and, again and again, of every chain
    that hangs from a chain already taken, in c only where over_pos >= p.
    """
    nodes = tree.nodes
    ends = nodes.groupBy("chain").agg(F.max("pos").alias("pos_to"))
    heads = nodes.filter("id = chain").select("chain", "parent")
    over = nodes.select(F.col("id").alias("pid"), F.col("chain").alias("over_chain"), F.col("pos").alias("over_pos"))
    hung = heads.join(over, heads["parent"] == F.col("pid"), "left").select("chain", "over_chain", "over_pos")
    return ends.join(hung, "chain").select("chain", F.lit(0).cast("long").alias("pos_from"), "pos_to", "over_chain", "over_pos")


def walk_down(tree: Hierarchy, of: DataFrame) -> DataFrame:
    """(ancestor, descendant) for the given ids only, by chain intervals: one round for each level of chains, not of records."""
    nodes = tree.nodes
    spans = descendants(tree)
    start = of.select(cleaned("id").alias("id")).distinct().join(nodes, "id").select(F.col("id").alias("ancestor"), "chain", (F.col("pos") + 1).alias("from"), F.col("pos").alias("open"))
    out, now = None, start
    while True:
        got = Cut(now.join(nodes.select("chain", "pos", F.col("id").alias("descendant")), "chain").filter("pos >= `from`").select("ancestor", "descendant"), "down").df
        out = got if out is None else out.unionByName(got)
        nxt = Cut(now.join(spans.select(F.col("chain").alias("sub"), "over_chain", "over_pos"), (F.col("chain") == F.col("over_chain")) & (F.col("over_pos") >= F.col("open"))).select("ancestor", F.col("sub").alias("chain"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("open")), "down").df
        if nxt.isEmpty():
            return out
        now = nxt
