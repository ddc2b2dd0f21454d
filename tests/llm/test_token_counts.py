import collections
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from lodeworks.llm import queries, token_counts
from lodeworks.llm.token_counts import TokenRollup
from lodeworks.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def count():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def _want(rows, count):
    total = collections.defaultdict(lambda: [0, 0])
    for source, lang, text in rows:
        g = total[source, lang]
        g[0] += 1
        g[1] += count(text)
    return {k: tuple(v) for k, v in total.items()}


def _got(df):
    return {(r.source, r.lang): (r.documents, r.tokens) for r in df.collect()}


def test_equals_counting_all_documents(spark, docs, count):
    rows = queries.op4_token_counts(spark, SF)
    assert {r.tokenizer for r in rows.collect()} == {"byte_bpe_50k@1"}
    assert _got(rows) == _want([(r.source, r.lang, r.text) for r in docs.collect()], count)


def test_batches_apply_once_and_add_up(spark, docs, count, tmp_path):
    roll = TokenRollup(spark, str(tmp_path / "roll"), {"v1": queries.tokenizer_path()})
    rows = {r.doc_id: (r.source, r.lang, r.text) for r in docs.collect()}
    assert roll.totals().count() == 0
    inserts = docs.selectExpr("'insert' AS op", "*")
    assert roll.commit("a", inserts) and not roll.commit("a", inserts)
    changes = spark.createDataFrame(
        [("delete", 1, None, None, None), ("revise", 2, "new", "en", "Two words"), ("delete", 10**9, None, None, None), ("insert", 3, "new", None, "again"), ("insert", 10**9 + 1, None, None, None), ("delete", None, None, None, None)],
        "op string, doc_id long, source string, lang string, text string",
    )
    assert roll.commit("b", changes) and not roll.commit("b", changes)
    del rows[1]
    rows[2], rows[3], rows[10**9 + 1] = ("new", "en", "Two words"), ("new", None, "again"), (None, None, None)
    assert _got(roll.totals()) == _want(rows.values(), count)
    assert roll.commit("c", spark.createDataFrame([("delete", d, "", "", "") for d in rows], changes.schema))
    assert roll.totals().count() == 0


def test_a_crashed_attempt_changes_nothing(spark, docs, tmp_path, monkeypatch):
    roll = TokenRollup(spark, str(tmp_path / "roll"), {"v1": queries.tokenizer_path()})
    one = docs.limit(3).selectExpr("'insert' AS op", "*")

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(token_counts, "publish", crash)
    with pytest.raises(OSError):
        roll.commit("x", one)
    monkeypatch.undo()
    assert roll.totals().count() == 0 and not roll.committed("x")
    assert roll.commit("x", one) and sum(r.documents for r in roll.totals().collect()) == 3


def test_two_writers_of_one_document(spark, tmp_path, monkeypatch):
    """The second takes back what the first has made, though it has read the state before."""
    path, schema = str(tmp_path / "roll"), "op string, doc_id long, source string, lang string, text string"
    one, two = (TokenRollup(spark, path, {"v1": queries.tokenizer_path()}) for _ in range(2))
    one.commit("a", spark.createDataFrame([("insert", 1, "s", "en", "one two")], schema))
    real, raced = token_counts.publish, []

    def late(spark_, at, text):
        if not raced:
            raced.append(0)
            raced.append(two.commit("b", spark.createDataFrame([("revise", 1, "s", "fr", "one two three")], schema)))
        return real(spark_, at, text)

    monkeypatch.setattr(token_counts, "publish", late)
    assert one.commit("c", spark.createDataFrame([("revise", 1, "s", "de", "one")], schema))
    assert raced == [0, True]
    assert {(r.lang, r.documents) for r in one.totals().collect()} == {("de", 1)}


def test_writers_at_once_make_one_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        for k in range(5):
            made = list(pool.map(lambda n, k=k: store.publish(spark, f"{tmp_path}/{k}", f"text {n}"), range(8)))
            assert made.count(True) == 1 and store.read_text(spark, f"{tmp_path}/{k}") == f"text {made.index(True)}"
    assert sorted(n for n in os.listdir(tmp_path) if not n.endswith(".crc")) == list("01234")


def test_publish_by_rename(spark, tmp_path):
    """File systems other than the local one take the name by a rename."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./x", f"file://{tmp_path}")
    assert store.publish(spark, "viewfs://t/x/f", "one") and not store.publish(spark, "viewfs://t/x/f", "two")
    assert store.read_text(spark, "viewfs://t/x/f") == "one" and store.versions(spark, "viewfs://t/x") == []


def test_compaction_keeps_totals_and_batches(spark, docs, count, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT_AFTER", 2)
    roll = TokenRollup(spark, str(tmp_path / "roll"), {"v1": queries.tokenizer_path()})
    rows = [(r.doc_id, r.source, r.lang, r.text) for r in docs.limit(12).collect()]
    schema = "doc_id long, source string, lang string, text string, op string"
    for k in range(5):
        assert roll.commit(f"b{k}", spark.createDataFrame([(*r, "insert") for r in rows[: 2 * k + 2]], schema))
    assert roll.state().base and len(roll.state().batches) <= 1
    assert not any(roll.commit(f"b{k}", spark.createDataFrame([(*rows[0], "delete")], schema)) for k in range(5))
    assert _got(roll.totals()) == _want([r[1:] for r in rows[:10]], count)
    assert roll.commit("gone", spark.createDataFrame([(*r, "delete") for r in rows], schema)) and roll.totals().count() == 0


def test_odd_rows_and_empty_table(spark, odd_docs, count, tmp_path):
    roll = TokenRollup(spark, str(tmp_path / "odd"), {"v1": queries.tokenizer_path()})
    assert roll.commit("0", odd_docs.limit(0).selectExpr("'insert' AS op", "*")) and roll.totals().count() == 0
    assert roll.commit("1", odd_docs.selectExpr("'insert' AS op", "*"))
    assert _got(roll.totals()) == _want([(r.source, r.lang, r.text) for r in odd_docs.collect()], count)
    with pytest.raises(Exception, match="unknown op"):
        roll.commit("2", odd_docs.selectExpr("'upsert' AS op", "*"))
