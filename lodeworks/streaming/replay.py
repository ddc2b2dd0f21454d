"""A fetch log as a stream: outcomes are classified and the ledger keeps up, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeworks.operators.mutations import apply_ledger
from lodeworks.operators.outcomes import ledger_kind, outcome_kind
from lodeworks.sources.store import SnapshotStore


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def kinds_by_window(log: DataFrame, at: str, status: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Outcomes of each kind per window of event time; later rows than ``late`` are left out."""
    kind = log.withColumn("kind", outcome_kind(F.col(status))).withWatermark(at, late)
    return kind.groupBy(F.window(at, width), "kind").agg(F.count(F.lit(1)).alias("n"))


def keep_ledger(log: DataFrame, store: SnapshotStore, checkpoint: str):
    """Start a query that applies each batch to the stored ledger; a batch that comes again changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if store.version() > batch_id:
            return
        incoming = batch.select("item_id", "at", ledger_kind(outcome_kind(F.col("status"))).alias("status")).where("status <> 'ok'")
        old = store.read("ledger") if store.version() else batch.sparkSession.createDataFrame([], "item_id bigint, status string, attempts bigint")
        store.write({"ledger": apply_ledger(old, incoming, ["at"])})

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
