"""Which ids to fetch next, and when a backward scan is complete."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScanState:
    """The one row of scan state."""

    highest: int = 0
    floor: int | None = None
    cutoff: int | None = None
    completed: int | None = None
    scan_high: int = 0
    anchor: int | None = None

    def updated(self, **changes) -> "ScanState":
        """Fields that are None stay as they are."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def frontier_window(state: ScanState, lookahead: int, dry_streak: int) -> tuple[int, int]:
    """First and last id of the next look ahead; empty if the first is beyond the last."""
    start = max(state.scan_high, state.highest) + 1
    return start, min(start + lookahead - 1, state.highest + dry_streak)


def backward_window(state: ScanState, chunk: int) -> tuple[int, int]:
    """First id of the next chunk below the floor, and the floor."""
    floor = state.floor if state.floor is not None else state.highest + 1
    return max(floor - chunk, 1), floor


def highest_id(state: ScanState, items: DataFrame) -> DataFrame:
    return items.agg(F.greatest(F.coalesce(F.max("item_id"), F.lit(0)), F.lit(state.highest)).alias("highest"))


def unresolved(spark: SparkSession, low: int, high: int, *known: DataFrame) -> DataFrame:
    """Ids from ``low`` up to ``high`` that no table knows; only that range of the tables is read."""
    ids = spark.range(low, high).withColumnRenamed("id", "item_id")
    for table in known:
        ids = ids.join(table.where(F.col("item_id").between(low, high - 1)).select("item_id"), "item_id", "left_anti")
    return ids


def gaps(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(gap_start, gap_end) between known ids, without making a row for each missing one.

    Ids are ordered within ranges of a million, then the ranges' ends with each other.
    """
    ids = items.select(F.col(key).alias("id")).distinct().withColumn("part", F.floor(F.col("id") / 1_000_000))
    inside = ids.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id"))).where("next > id + 1").select("id", "next")
    ends = ids.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    across = ends.select(F.col("high").alias("id"), F.lead("low").over(Window.orderBy("part")).alias("next")).where("next > id + 1")
    return inside.unionAll(across).select((F.col("id") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"))


def due_queue(rows: DataFrame, when: str, as_of: Column, limit: int, tie: str) -> DataFrame:
    """Rows whose time has come, the longest overdue first."""
    return rows.where(F.col(when).isNotNull() & (F.col(when) <= as_of)).orderBy(when, tie).limit(limit)


def window_is_old(items: DataFrame, ledger: DataFrame, low: int, size: int, cutoff: Column) -> DataFrame:
    """One row: whether ``size`` ids from ``low`` hold dated items, all before the cutoff, and no id is still open."""
    ids = F.col("item_id").between(low, low + size - 1)
    dated = items.where(ids).agg(F.count("added_at").alias("dated"), F.bool_and(F.when(F.col("added_at").isNotNull(), F.col("added_at") < cutoff)).alias("all_old"))
    open_ids = ledger.where(ids & ~F.col("status").isin("gone", "internal_gap")).agg(F.count(F.lit(1)).alias("pending"))
    both = dated.select("dated", F.coalesce("all_old", F.lit(False)).alias("all_old"), F.lit(1).alias("_one")).join(open_ids.withColumn("_one", F.lit(1)), "_one")
    return both.select("dated", "all_old", "pending", ((F.col("dated") > 0) & F.col("all_old") & (F.col("pending") == 0)).alias("confirmed"))


def advance(state: ScanState, floor: int, confirmed: bool, margin: int, as_of: int) -> ScanState:
    """State after a backward chunk: an anchor holds while windows stay old, and the scan is complete
    once the floor lies ``margin`` below it."""
    anchor = None if not confirmed else state.anchor if state.anchor is not None else floor
    done = as_of if anchor is not None and anchor - floor >= margin else state.completed
    return replace(state, floor=floor, anchor=anchor, completed=done)


def anchored(floors: DataFrame, margin: int, span: int = 1_000_000) -> DataFrame:
    """``floors`` (floor, confirmed) with anchor and complete, as ``advance`` finds them floor by floor downwards.

    The anchor is the highest floor of the run of confirmed ones that the floor is in; a run is complete from ``margin`` below
    it on. Floors are put in order within spans of ids; of each span the last unconfirmed floor carries over.
    """
    own = floors.withColumns({"_span": F.floor(F.col("floor") / span), "_open": F.when(~F.col("confirmed"), F.col("floor"))})
    above = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    edges = own.groupBy("_span").agg(F.min("_open").alias("_low"), F.max("floor").alias("_top"))
    carried = edges.select("_span", F.min("_low").over(above).alias("_above"))
    inside = Window.partitionBy("_span").orderBy(F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0)
    last = own.join(carried, "_span").withColumn("_last", F.coalesce(F.min("_open").over(inside), F.col("_above")))
    begins = last.where("confirmed").groupBy("_last").agg(F.max("floor").alias("_anchor"))
    joined = last.join(begins.withColumnRenamed("_last", "_of"), F.col("_last").eqNullSafe(F.col("_of")), "left")
    anchor = F.when(F.col("confirmed"), F.col("_anchor"))
    return joined.select(*floors.columns, anchor.alias("anchor"), (F.col("confirmed") & (anchor - F.col("floor") >= margin)).alias("complete"))


def bootstrapped(state: ScanState, cutoff: int, newest: int) -> ScanState:
    """The state before a first cycle, or with an earlier cutoff, which takes the scan up again; else as it is.

    ``newest``: the largest id that the listing pages link to, 0 if none.
    """
    if state.cutoff is None:
        return replace(state, scan_high=max(state.scan_high, newest - 1, 0), cutoff=cutoff, floor=newest or 1)
    if cutoff < state.cutoff:
        return replace(state, cutoff=cutoff, completed=None, anchor=None)
    return state


def listed_ids(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """The largest id that the pages link to, 0 without any."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("id"))
    return found.agg(F.coalesce(F.max(F.col("id").try_cast("bigint")), F.lit(0)).alias("highest"))


#: The order of a cycle's phases.
CYCLE = ("retry", "frontier", "backward", "refresh")


def plan_cycle(spark: SparkSession, state: ScanState, items: DataFrame, ledger: DataFrame, as_of: Column, lookahead=500, dry_streak=200, chunk=500, batch=200) -> DataFrame:
    """(item_id, phase) of the next cycle's fetches."""
    parts = []
    for phase in CYCLE:
        if phase == "retry":
            ids = due_queue(ledger, "next_retry_at", as_of, batch, "item_id").select("item_id")
        elif phase == "refresh":
            ids = due_queue(items, "next_refresh_at", as_of, batch, "item_id").select("item_id")
        else:
            low, high = frontier_window(state, lookahead, dry_streak) if phase == "frontier" else backward_window(state, chunk)
            ids = unresolved(spark, low, high + (phase == "frontier"), items, ledger)
        parts.append(ids.withColumn("phase", F.lit(phase)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
