"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is turned into signed entries: an insert adds a document's counts, a
delete takes back what is live for its id, and a revision does both. Entries and their
sums per group are written under a name of their own. The log has one file for each version,
which takes its number exclusively: a batch is applied to the version before its own, and a writer that
finds its number taken starts again from the newer state. So a repeated or crashed attempt
changes nothing, and two writers never take back the same entry twice.

Every few versions the log is compacted: what is live goes to buckets by the hash of its id,
the totals to one small table, and the log goes on from there. A commit reads the buckets and the few batches since.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.tokens import BpeEncoder, slices
from lodeworks.sources.store import publish, read_text, versions

ENTRY = "doc_id long, source string, lang string, tokenizer string, documents long, tokens long"
SUMS = ENTRY.replace("doc_id long, ", "")
GROUP = ["source", "lang", "tokenizer"]
#: Batches between compactions, and buckets of live entries.
COMPACT_AFTER, BUCKETS = 16, 64


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """One entry for each row and tokenizer version; ``tokenizers``: vocabulary file by version."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for version, path in sorted(tokenizers.items()):
                    _, counts = BpeEncoder.load(path).encode(part.column("text"))
                    n = len(part)
                    columns = [part.column(c) for c in ("doc_id", "source", "lang")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([version] * n, pa.string()), pa.array(np.ones(n, np.int64)), pa.array(counts)], ["doc_id", *GROUP, "documents", "tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return plain.mapInArrow(made, ENTRY)


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    """Sums per key, without those that are nothing."""
    return rows.groupBy(*key).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")


@dataclass(frozen=True)
class State:
    """A version of the log: its base, and the batches since with their attempts."""

    version: int
    base: str | None
    batches: dict[str, str]


class TokenRollup:
    """Totals in shared storage at ``path``."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str]):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> State:
        """The latest version: its files are read back to the last compaction, a bounded number of them."""
        known = versions(self.spark, f"{self.path}/log")
        batches = {}
        for v in reversed(known):
            entry = json.loads(read_text(self.spark, f"{self.path}/log/{v}"))
            if "base" in entry:
                return State(known[-1], entry["base"], batches)
            batches[entry["batch"]] = entry["attempt"]
        return State(known[-1] if known else 0, None, batches)

    def _done(self, batch_id: str) -> str:
        return f"{self.path}/done/{batch_id}"

    def committed(self, batch_id: str, state: State | None = None) -> bool:
        state = state or self.state()
        return batch_id in state.batches or self._fs.exists(self._at(self._done(batch_id)))

    def _read(self, state: State, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        if state.base:
            out = self.spark.read.schema(schema + (", bucket int" if kind == "entries" else "")).parquet(f"{state.base}/{kind}").drop("bucket")
        paths = [f"{self.path}/{kind}/{a}" for a in state.batches.values()]
        return out.unionByName(self.spark.read.schema(schema).parquet(*paths)) if paths else out

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it is there already.

        ``changes``: op (``insert``, ``delete`` or ``revise``), doc_id, source, lang, text. Whatever
        the op, what is live for the id is taken back first, so an insert of a known id is
        a revision and a delete of an unknown one does nothing. Rows of a batch that share an id all count. A
        null id never matches a live one. Null sources and languages are groups of their
        own, null texts have no tokens, unknown ops raise. An empty batch is committed as well.
        """
        if not batch_id or "/" in batch_id or batch_id.startswith("."):
            raise ValueError(f"not a batch id: {batch_id!r}")
        op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.lit("unknown op")))
        changes = changes.withColumn("op", op)
        new = None
        while True:
            state = self.state()
            if self.committed(batch_id, state):
                return False
            attempt = uuid.uuid4().hex
            if new is None:  # what comes in is counted once, however often others are first
                new = f"{self.path}/counted/{attempt}"
                counted(changes.where("op <> 'delete'"), self.tokenizers).write.parquet(new)
            entries = self.spark.read.schema(ENTRY).parquet(new)
            if state.version:
                touched = changes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
                gone = _summed(self._read(state, "entries", ENTRY).join(touched, "doc_id", "left_semi"), "doc_id", *GROUP)
                entries = entries.unionAll(gone.select("doc_id", *GROUP, -F.col("documents"), -F.col("tokens")))
            entries.write.parquet(f"{self.path}/entries/{attempt}")
            own = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/{attempt}")
            _summed(own, *GROUP).write.parquet(f"{self.path}/deltas/{attempt}")
            if publish(self.spark, f"{self.path}/log/{state.version + 1}", json.dumps({"batch": batch_id, "attempt": attempt})):
                break
            for kind in ("entries", "deltas"):  # another writer was first
                self._drop(f"{self.path}/{kind}/{attempt}")
        self._drop(new)
        if len(state.batches) + 1 >= COMPACT_AFTER:
            self.compact()
        return True

    def compact(self) -> bool:
        """Put all versions into a new base; False if another writer was first, which changes nothing."""
        state = self.state()
        if not state.batches:
            return False
        base = f"{self.path}/base/{uuid.uuid4().hex}"
        live = _summed(self._read(state, "entries", ENTRY), "doc_id", *GROUP)
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        live.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{base}/entries")
        _summed(self._read(state, "deltas", SUMS), *GROUP).write.parquet(f"{base}/deltas")
        for batch in state.batches:  # before they leave the log
            publish(self.spark, self._done(batch), base)
        if not publish(self.spark, f"{self.path}/log/{state.version + 1}", json.dumps({"base": base})):
            self._drop(base)
            return False
        return True

    def _drop(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of all committed batches; groups without documents are left out."""
        return _summed(self._read(self.state(), "deltas", SUMS), *GROUP)
