"""State changes as functions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import source_list, source_of
from lodeworks.sources.store import SnapshotStore

#: Fixed value: the method of a match that was taken over.
SIBLING = "resolution_sibling"


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Incoming rows replace stored ones of the same key, but for the columns in ``keep``, which stay.

    Incoming rows have one row for each key.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    new = F.col(f"i.{key}").isNotNull()
    columns = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        columns.append((F.coalesce(old, fresh) if c in keep else F.coalesce(F.col(f"i.{c}"), old) if c == key else F.when(new, fresh).otherwise(old)).alias(c))
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full").select(*columns)


def insert_missing(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows and those incoming ones whose key is new."""
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def apply_items(items: DataFrame, ledger: DataFrame, parsed: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Items and ledger after successes: first sight stays, the read time is now, ledger rows of successes go."""
    incoming = parsed.withColumn("scraped_at", as_of).withColumn("first_seen_at", as_of)
    return upsert(items, incoming, "item_id", keep=["first_seen_at"]), ledger.join(parsed.select("item_id"), "item_id", "left_anti")


def apply_ledger(ledger: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Ledger (item_id, status, attempts) after more outcomes: the last status counts, each adds an attempt."""
    added = incoming.groupBy("item_id").agg(F.max_by("status", F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n"))
    old = ledger.select("item_id", F.col("status").alias("_old"), F.col("attempts").alias("_attempts"))
    both = old.join(added, "item_id", "full")
    return both.select("item_id", F.coalesce("status", "_old").alias("status"), (F.coalesce("_attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("attempts"))


def reclassify(ledger: DataFrame, highest: Column) -> DataFrame:
    """What was missing at the frontier is a gap once the frontier has passed it."""
    passed = (F.col("status") == "frontier_missing") & (F.col("item_id") < highest)
    return ledger.withColumn("status", F.when(passed, "internal_gap").otherwise(F.col("status")))


def bump(items: DataFrame, ids: DataFrame, when: Column, column: str = "next_refresh_at") -> DataFrame:
    """Items with a new refresh time for the given ids."""
    hit = items.join(ids.select("item_id", F.lit(True).alias("_hit")).distinct(), "item_id", "left")
    return hit.withColumn(column, F.when(F.col("_hit"), when).otherwise(F.col(column))).drop("_hit")


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of parents that come in are replaced; the others stay."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def record_outcomes(attempts: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Attempts after outcomes (item_id, work_id, status, method, match_score, wait): all but matches clear the work."""
    work = F.when(F.col("status") == "matched", F.col("work_id"))
    incoming = outcomes.withColumn("work_id", work).withColumn("attempted_at", as_of).withColumn("next_retry_at", as_of + F.make_dt_interval(secs=F.col("wait")))
    prior = attempts.select("item_id", F.col("attempts").alias("_before"))
    incoming = incoming.join(prior, "item_id", "left").withColumn("attempts", F.coalesce("_before", F.lit(0)) + 1).drop("_before", "wait")
    return upsert(attempts, incoming, "item_id")


def source_column(item_id: Column) -> Column:
    """The source as stored attempts keep it, read back: through the JSON list, null if none is named."""
    return source_of(F.when(item_id.isNotNull(), source_list(item_id)))


def save_reused(attempts: DataFrame, reused: DataFrame, as_of: Column) -> DataFrame:
    """Attempts after matches were taken over (item_id, work_id, group_key, source_id, match_score).

    They are matched by the sibling's method with one candidate, name their source in ``candidates``, and aren't due again.
    """
    prior = attempts.select("item_id", F.col("attempts").alias("_before"))
    made = {
        "status": F.lit("matched"),
        "method": F.lit(SIBLING),
        "candidates": source_list(F.col("source_id")),
        "candidate_count": F.lit(1),
        "attempts": F.coalesce("_before", F.lit(0)) + 1,
        "attempted_at": as_of,
        "next_retry_at": F.lit(None).cast("timestamp"),
    }
    return upsert(attempts, reused.join(prior, "item_id", "left").withColumns(made).drop("_before", "source_id"), "item_id")


def save_bundle(store: dict[str, DataFrame], bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after a batch of matched bundles: four upserts and the works' people replaced."""
    out = dict(store)
    for name, key in (("networks", "network_id"), ("sites", "site_id"), ("works", "work_id"), ("people", "person_id")):
        out[name] = upsert(store[name], bundle[name], key)
    out["bridge"] = replace_children(store["bridge"], bundle["bridge"], "work_id")
    return out


def write_bundle(store: SnapshotStore, bundle: dict[str, DataFrame], attempts: DataFrame, outcomes: DataFrame, as_of: Column) -> int:
    """Matched works with all that belongs to them and the attempts that found them, visible together as one version; its number."""
    version = store.version()
    names = ("networks", "sites", "works", "people", "bridge")
    old = {n: store.read(n, version) for n in names} if version else {n: bundle[n].limit(0) for n in names}
    return store.write({**save_bundle(old, bundle), "attempts": record_outcomes(attempts, outcomes, as_of)})


def null_missing(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent is gone point to none."""
    known = parents.select(F.col(parent_key).alias("_known")).distinct()
    joined = rows.join(known, F.col(key) == F.col("_known"), "left")
    return joined.withColumn(key, F.col("_known")).drop("_known")


def backfilled(rows: DataFrame, column: str, *sources: Column) -> DataFrame:
    """The column's nulls filled from the first source that isn't null."""
    return rows.withColumn(column, F.coalesce(F.col(column), *sources))
