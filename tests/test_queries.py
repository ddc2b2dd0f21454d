import os

import duckdb
import pytest

import __spark_entry__
from lodeworks.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[k], 4) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert _rows(found.columns, found.collect()) == _rows(names, want.fetchall())


def test_images_of_a_work_without_items(spark, tmp_path):
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    orders = str(tmp_path / "orders.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey <> 7").write.parquet(orders)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/*.parquet'")
    want = con.execute(registry.ORACLES["work_detail_images"]).fetchall()
    assert [tuple(x) for x in registry.QUERIES["work_detail_images"](spark, str(tmp_path)).collect()] == want == [(None,)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
