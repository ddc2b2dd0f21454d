import os

import corpus_pipeline
from lodeworks.llm import common, simhash
from tests.llm.test_decontamination import _words
from tests.llm.test_packing import reference  # noqa: F401
from tests.llm.test_sentence_spans import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_print

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark, docs, reference):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [(d, t) for d, t in rows if any(map(str.isalpha, t))]
    components = brute_components([(d, brute_print(t)) for d, t in kept])
    kept = [(d, t) for (d, t), c in zip(kept, components) if c == d]
    cut = brute_spans(kept, 30)
    kept = [(d, cut.get((d, t), t)) for d, t in kept]
    items = [" " + " ".join(_words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in kept if not any(i in " " + " ".join(_words(t)) + " " for i in items)]
    want = {d: [*reference.encode(t, add_special_tokens=False).ids, 0] for d, t in kept}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        import numpy as np

        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert len(kept) < len(rows) and got == want


def test_stages_keep_the_columns(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.dtypes == docs.dtypes


def test_columns_of_any_name_keep_their_values(spark, odd_docs):
    out = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.asDict() for r in out.collect()}
        out = stage(spark, out, SF)
        assert out.dtypes == odd_docs.dtypes
        for r in out.collect():
            assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in before[r.doc_id].items() if k not in ("text", "n_chars")}, name


def test_one_of_each_component_stays(spark):
    copy = "".join(f"these {k} words are the same in each of the copies of it " for k in range(60))
    rows = [(5, copy, "a"), (3, copy, "b"), (3, copy, "b"), (3, copy + " one more", "c"), (None, copy, "d"), (9, "quite another text that has nothing in common with them", "e"), (None, None, "f"), (None, None, "g"), (None, "", "h"), (1, "yet another text about the weather of tomorrow", "i"), (1, "and one about all the ships in the harbour tonight", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = simhash.deduplicated(docs)
    assert got.dtypes == docs.dtypes
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert len([r for r in rows if r[0] == 3]) == 1 and len([r for r in rows if r[0] == 1]) == 2 and len(rows) == 5
    assert len([r for r in rows if not r[1]]) == 1 and (9, "quite another text that has nothing in common with them") in rows
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_their_result_alone(spark, tmp_path):
    before = common.release(spark)
    out = corpus_pipeline.run(spark, SF)
    kept = list(common._MADE.paths)
    assert len(kept) == 1 and out.count() > 0
    assert common.release(spark) == 1 and not os.path.exists(kept[0]) and before >= 0


def test_odd_rows(spark, odd_docs, tmp_path):
    for table in ("documents", "benchmark"):
        (odd_docs.select("doc_id", "text", "lang", "source", "n_chars") if table == "documents" else spark.read.parquet(f"{SF}/benchmark.parquet")).write.parquet(str(tmp_path / f"{table}.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept >= {4, 6, 7, 8} and not kept & {1, 2, 3, 5}
