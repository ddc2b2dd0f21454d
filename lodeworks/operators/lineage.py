"""Repair of match lineages: who took a match over from whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.store import cut_lineage


def roots(edges: DataFrame) -> DataFrame:
    """(node, root, depth) for edges (node, parent) with at most one parent each, by pointer doubling.

    A chain of n needs log2(n) rounds, whatever the recursion limit. Nodes on or behind a
    cycle have no root and give no row.
    """
    own = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    tops = own.select(F.col("parent").alias("node")).join(own.select("node"), "node", "left_anti").distinct()
    state = own.select("node", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("depth"), F.lit(False).alias("done"))
    state = state.unionAll(tops.select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("done")))
    state = cut_lineage(state)
    open_before = None
    while True:
        hop = state.select(F.col("node").alias("at"), F.col("at").alias("_to"), F.col("depth").alias("_more"), F.col("done").alias("_done"))
        step = state.join(hop, "at", "left")
        state = cut_lineage(step.select("node", F.coalesce("_to", "at").alias("at"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")))
        left = state.where("not done").count()
        if not left or left == open_before:  # each round settles the open node nearest to a root, if one leads there
            break
        open_before = left
    return state.where("done").select("node", F.col("at").alias("root"), "depth")


def _below(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): nodes with a seed among their ancestors, for at most one parent each, by pointer doubling."""
    hit = seeds.select(F.col("node").alias("parent"), F.lit(True).alias("hit"))
    state = cut_lineage(edges.join(hit, "parent", "left").select("node", F.col("parent").alias("at"), F.coalesce("hit", F.lit(False)).alias("hit")))
    open_before = None
    while (left := state.where("not hit and at is not null").count()) and left != open_before:  # in cycles without a seed some stay open
        open_before = left
        hop = state.select(F.col("node").alias("at"), F.col("at").alias("_to"), F.col("hit").alias("_hit"))
        step = state.join(hop, "at", "left")
        state = cut_lineage(step.select("node", F.col("_to").alias("at"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
    return state.where("hit").select("node")


def closure(seeds: DataFrame, edges: DataFrame, pieces: int = 16) -> DataFrame:
    """(node): seeds and all that edges (node, parent) lead to from them, each once; edges with a null end lead nowhere.

    Where no node has two parents, it takes a logarithmic number of rounds. Else each round adds the nodes that
    the last one has newly reached, until there are none; what is known is written anew every ``pieces`` rounds alone.
    """
    seeds = cut_lineage(seeds.select("node").where("node IS NOT NULL").distinct())
    edges = cut_lineage(edges.select("node", "parent").where("node IS NOT NULL AND parent IS NOT NULL").distinct())
    if not edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return seeds.unionAll(_below(seeds, edges)).distinct()
    fresh, known, rounds = seeds, seeds, 0
    while fresh.limit(1).count():
        reached = edges.join(fresh.select(F.col("node").alias("parent")), "parent", "left_semi").select("node").distinct()
        fresh = cut_lineage(reached.join(known, "node", "left_anti"))
        known, rounds = known.unionAll(fresh), rounds + 1
        if rounds % pieces == 0:
            known = cut_lineage(known)
    return known


def sibling_edges(attempts: DataFrame) -> DataFrame:
    """(node, parent) where an attempt names its source, for the same work and, nulls being equal, the same key."""
    child = attempts.where("source_id IS NOT NULL").alias("c")
    parent = attempts.alias("p")
    same = (F.col("c.source_id") == F.col("p.item_id")) & (F.col("c.work_id") == F.col("p.work_id")) & F.col("c.group_key").eqNullSafe(F.col("p.group_key"))
    return child.join(parent, same).select(F.col("c.item_id").alias("node"), F.col("p.item_id").alias("parent"))


def without_legacy(attempts: DataFrame, legacy: Column) -> DataFrame:
    """Attempts without legacy ones and all that were taken over from them."""
    gone = closure(attempts.where(legacy).select(F.col("item_id").alias("node")), sibling_edges(attempts))
    return attempts.join(gone.select(F.col("node").alias("item_id")), "item_id", "left_anti")


def rescored(attempts: DataFrame) -> DataFrame:
    """Siblings take their root's score and name the root as source; a root has a score and no source."""
    found = roots(sibling_edges(attempts)).where("depth > 0")
    root = attempts.where("match_score IS NOT NULL AND source_id IS NULL").select(F.col("item_id").alias("root"), F.col("match_score").alias("_score"))
    fixed = found.join(root, "root").select(F.col("node").alias("item_id"), "root", "_score")
    joined = attempts.join(fixed, "item_id", "left")
    return joined.withColumns({"source_id": F.coalesce("root", "source_id"), "match_score": F.coalesce("_score", "match_score")}).drop("root", "_score")


def repair(attempts: DataFrame, legacy: Column) -> tuple[DataFrame, dict[str, int]]:
    """Attempts after both steps, and how many rows were deleted and changed."""
    kept = cut_lineage(without_legacy(attempts, legacy))
    after = cut_lineage(rescored(kept))
    old = kept.select("item_id", F.col("source_id").alias("_s"), F.col("match_score").alias("_m"))
    same = F.col("source_id").eqNullSafe(F.col("_s")) & F.col("match_score").eqNullSafe(F.col("_m"))
    changed = after.join(old, "item_id").where(~same).count()
    return after, {"deleted": attempts.count() - kept.count(), "updated": changed}
