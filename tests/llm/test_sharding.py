import collections
import zlib

import numpy as np

from lodeworks.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def _check(rows, docs, spread):
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    by = collections.defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    load = [sum(r.size for r in by[s]) for s in range(16)]
    assert max(load) - min(load) <= spread, load


def test_bytes_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    total = sum(len(r.text.encode()) + 1 for r in docs)
    _check(queries.op8_sharding(spark, "/root/testdata/sf0.01").collect(), docs, 0.01 * total / 16)


def test_odd_rows_and_empty_table(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    _check(queries.op8_sharding(spark, str(tmp_path)).collect(), odd_docs.collect(), 10**9)
    assert sharding.shard(odd_docs.limit(0)).rows.count() == 0


def test_many_buckets_number_without_gaps(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    rows = sharding.shard(docs, shards=3, slots=8).rows.collect()
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_versions_and_growth(spark, docs):
    made = sharding.shard(docs, shards=4, slots=512)
    grown = made.store.save(made.slot_map.grown(made.sizes))
    assert made.store.load(0) == sharding.SlotMap.first(512, 4)
    assert made.store.load(1) == made.slot_map and made.store.load() == grown
    assert all(b in (a, 4) for a, b in zip(made.slot_map.shard_of, grown.shard_of)) and 4 in grown.shard_of
    load = np.bincount(grown.shard_of, made.sizes)
    assert load.max() < 1.3 * load.mean()


def test_query_equals_brute_force(spark):
    """Places that follow from the stored map, one row after the other."""
    made = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), shards=16, slots=4096)
    rows = made.rows.collect()
    expected = spark.createDataFrame([(r.doc_id, r.text_crc32) for r in rows], "doc_id long, text_crc32 long").selectExpr("doc_id", "text_crc32", "cast(pmod(xxhash64(doc_id, text_crc32, 0L), 4096) as int) AS v")
    slot = {(r.doc_id, r.text_crc32): r.v for r in expected.collect()}
    assert len(slot) == len(rows)
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.virtual_slot, r.doc_id, r.text_crc32)):
        assert r.virtual_slot == slot[r.doc_id, r.text_crc32] and r.shard == made.slot_map.shard_of[r.virtual_slot]
        by[r.shard].append(r)
    for own in by.values():
        assert [r.slot for r in own] == list(range(len(own)))


def test_one_record_of_half_of_all_rows_spreads(spark):
    rows = [(7, "the same text over and over again")] * 3000 + [(None, None)] * 1000 + [(k, f"text number {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sharding.shard(docs, shards=16, slots=512).rows.collect()
    load = collections.Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(out) == len(rows) and max(load.values()) < 1.05 * sum(load.values()) / 16
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
