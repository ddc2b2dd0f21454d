"""Connected components of a distributed graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import drop_stored, stored


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("low", "high"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node that has a link to another; label: the smallest node reachable.

    Large-star and small-star steps turn the graph into stars around the smallest
    nodes in a logarithmic number of rounds. Minima are taken by partial aggregation and
    joined back, so a node with very many links is split like any skewed join key. Rows
    with a null end are no links; repeated links count once; no links give no rows.
    """
    one = edges.where(F.col(a) != F.col(b))
    state = stored(one.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(), "links")
    before = _signature(state)
    while before[0]:
        both = state.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(state.select(F.col("high").alias("u"), F.col("low").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        large = stored(large, "links")
        nearest = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(nearest, "high")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).where("low < high")
        after = stored(small.unionAll(nearest.select(F.col("m").alias("low"), "high")).distinct(), "links")
        drop_stored(large)
        drop_stored(state)
        state, now = after, _signature(after)
        if now == before:
            break
        before = now
    return state.select(F.col("high").alias("node"), F.col("low").alias("label"))
