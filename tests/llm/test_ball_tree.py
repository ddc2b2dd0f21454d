import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import ball_tree, queries


def brute(rows, asked, k):
    x = [(i, [math.floor(256 * float(np.float64(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in x:
        if asked(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in x if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = sorted(map(tuple, queries.op9_exact_top_k(spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    names = ["query_id", "rank", "vec_id", "score"]
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op9_exact_top_k']})").fetchall())
    assert got == brute([(r.vec_id, r.embedding) for r in rows.collect()], lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("block", [4096, 7])
def test_ties_nulls_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ball_tree, "BLOCK", block)
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    monkeypatch.setattr(ball_tree, "TREE", 32)
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.integers(-2, 3, 6)]) for i in range(150)]
    rows += [(200, None), (205, []), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (215, [math.nan] * 6), (220, [math.inf] * 6), (None, [9.0] * 6), (225, [1.0, 2.0]), (230, [1e30] * 6)]
    rows += [rows[3], rows[10]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    some = [x for x in rows if x[0] != 230]
    got = ball_tree.top_k(table.where("vec_id IS NULL OR vec_id <> 230"), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == brute(some, lambda i: i % 5 == 0, 5)
    assert ball_tree.top_k(table, F.col("vec_id") == 230).count() == 5
    assert ball_tree.top_k(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_large_values_are_exact():
    a = np.array([[3 * 10**9 + 1, 7]])
    assert ball_tree.products(a, a)[0, 0] == (3 * 10**9 + 1) ** 2 + 49
