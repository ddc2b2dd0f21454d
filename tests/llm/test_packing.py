import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import packing, queries
from lodeworks.llm.tokens import BpeEncoder, slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_ids_equal_those_of_tokenizers(reference):
    texts = ["", "a  b", "a   b", " x", "  y ", "a\n b", "a \nb", "a \n b\n\n c ", "<|endoftext|> z", "it's   ok b  c", "\t\ta b", "é ñ 漢字 😀 x", "1 2.5!? ..."]
    encoder = BpeEncoder.load(queries.tokenizer_path())
    ids, counts = encoder.encode(pa.array([None, *texts]))
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [[]] + [reference.encode(t, add_special_tokens=False).ids for t in texts]


def _check(rows, docs, reference):
    whole = {}
    for r in docs:
        whole.setdefault(r.doc_id, []).append([*reference.encode(r.text or "", add_special_tokens=False).ids, 0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == whole.keys()
    for doc, pieces in by_doc.items():
        ids = whole[doc][0]
        assert all(x == ids for x in whole[doc]) and sum(p.length for p in pieces) == len(ids) * len(whole[doc])
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    padded = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        n = sum(p.length for p in pieces)
        assert n <= 1024
        total += n
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded < 0.03 * max(total, 1)


def test_every_id_lies_in_one_piece(spark, docs, reference):
    _check(queries.op1_packing(spark, SF).collect(), docs.collect(), reference)


def test_odd_rows_and_empty_table(spark, odd_docs, reference, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    _check(queries.op1_packing(spark, str(tmp_path)).collect(), odd_docs.collect(), reference)
    assert packing.pack(odd_docs.limit(0), queries.tokenizer_path()).count() == 0


def test_many_slices_of_a_batch(spark, docs, reference, monkeypatch):
    """Batches cut into slices of one text or a few, with tokens that carry over from slice to slice."""
    monkeypatch.setattr(packing, "slices", lambda batch, column: slices(batch, column, 3_000))
    rows = packing.pack(docs.coalesce(1), queries.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).collect()
    _check(rows, docs.collect(), reference)


def test_slices_have_the_ids_of_their_texts(docs, odd_docs):
    texts = [r.text for r in docs.collect()] + [r.text for r in odd_docs.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(11)
    encoder = BpeEncoder.load(queries.tokenizer_path())
    want, counts = encoder.encode(pa.array(texts[11:]))
    parts = [encoder.encode(part.column("text")) for part in slices(batch, "text", 2_000)]
    assert len(parts) > 50 and (np.concatenate([p[0] for p in parts]) == want).all() and (np.concatenate([p[1] for p in parts]) == counts).all()


def test_pieces_keep_the_order_of_documents(spark, docs):
    one = packing.pack(docs.coalesce(1), queries.tokenizer_path()).collect()
    assert [r.doc_id for r in one] == sorted(r.doc_id for r in one)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_as_little_as_brute_force(seed):
    r = random.Random(seed)
    place = [0, *itertools.accumulate(r.randint(1, 5) for _ in range(12))]
    cost = [0, *(r.choice([0, 1, 3]) for _ in place[1:])]
    cost[-1] = 0
    window = 8

    def price(cuts):
        ends = [0, *cuts]
        if any(place[b] - place[a] > window for a, b in zip(ends, ends[1:])):
            return 10**9
        return sum(cost[j] + window - (place[j] - place[i]) for i, j in zip(ends, ends[1:-1]))

    last = len(place) - 1
    options = [[*c, last] for n in range(last) for c in itertools.combinations(range(1, last), n)]
    assert price(packing.best_cuts(place, cost, window, True)) == min(map(price, options))


def test_blocks_carry_over(reference):
    encoder = BpeEncoder.load(queries.tokenizer_path())
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta.", "gamma", "d\n"]) for _ in range(r.randint(0, 900))) for _ in range(40)]
    stream, got = packing.Stream(encoder, 64, 2, 8, 16, 0), []
    for k, t in enumerate(texts):
        ids, counts = encoder.encode(pa.array([t]))
        stream.add([k], np.insert(ids, np.cumsum(counts), 0), counts + 1)
        got.append(stream.cut(final=False))
    got.append(stream.cut(final=True))
    out = pa.Table.from_batches([b for b in got if b is not None]).to_pylist()
    for k, t in enumerate(texts):
        blob = b"".join(p["ids"] for p in out if p["doc_id"] == k)
        assert blob == np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
