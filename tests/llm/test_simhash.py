import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from lodeworks.llm import queries, simhash, tokens

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))


def brute_components(prints):
    """prints: (id, fingerprint) rows -> the component of each row."""
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(prints))]


def _same(rows, docs):
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == want


def test_equals_brute_force(spark, docs):
    _same(queries.op2_simhash_near_dedup(spark, SF).collect(), docs.collect())


def test_odd_rows_and_empty_table(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    _same(queries.op2_simhash_near_dedup(spark, str(tmp_path)).collect(), odd_docs.collect())
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_links_over_many_tiles_lose_no_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    r = random.Random(5)
    prints = set()
    for _ in range(12):
        p = r.getrandbits(64)
        for _ in range(20):
            prints.add(p)
            p ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
    prints = sorted(prints)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    at = {p: p for p in prints}

    def root(p):
        while at[p] != p:
            p = at[p]
        return p

    for row in simhash.links(table, 4).collect():
        a, b = (int(np.int64(x).astype(np.uint64)) for x in row)
        at[root(a)] = root(b)
    want = brute_components(list(enumerate(prints)))
    got = {}
    for i, p in enumerate(prints):
        got.setdefault(root(p), []).append(i)
    assert [min(got[root(p)]) for p in prints] == want


def test_slices_of_a_batch_have_the_fingerprints_of_their_texts(docs, odd_docs):
    """Batches of many slices, with nulls, and slices of other arrays."""
    texts = [r.text for r in docs.collect()] + [r.text for r in odd_docs.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    want = [brute_print(t) for t in texts]
    for source, expected in ((batch, want), (batch.slice(37), want[37:]), (batch.slice(37).slice(5, 90), want[42:132])):
        for size in (1_000, 20_000, 1_000_000):
            parts = list(tokens.slices(source, "text", size))
            assert [int(p) for part in parts for p in simhash.fingerprints(part.column("text"), 4)] == expected
    assert len(list(tokens.slices(batch, "text", 1_000))) > 50
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(texts, kind)
        assert [int(p) for k in range(0, len(texts), 23) for p in simhash.fingerprints(array.slice(k, 23), 4)] == want


def test_near_pairs_join_what_all_pairs_join():
    r = np.random.default_rng(4)
    for _ in range(10):
        prints = np.unique(np.concatenate([p ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for p in r.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        a, b = prints[: len(prints) // 2], prints[len(prints) // 3 :]
        hit = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
        at = {int(p): int(p) for p in prints}

        def root(x):
            while at[x] != x:
                x = at[x]
            return x

        i, j = np.nonzero(hit)
        for x, y in zip(a[i].tolist(), b[j].tolist()):
            at[root(x)] = root(y)
        want = {p: root(p) for p in at}
        at = {p: p for p in at}
        got = simhash.near_pairs(a, b, 4)
        assert len(got[0]) < len(a) + len(b)
        for x, y in zip(*(g.tolist() for g in got)):
            at[root(x)] = root(y)
        assert all((want[p] == want[q]) == (root(p) == root(q)) for p in at for q in at)


def test_dense_hits_become_stars():
    r = np.random.default_rng(3)
    for _ in range(20):
        hit = r.random((40, 60)) < r.choice([0.02, 0.3])
        i, j = simhash._forest(hit)
        assert len(i) <= max(2 * sum(hit.shape), 200)

        def parts(pairs):
            at = list(range(100))

            def root(x):
                while at[x] != x:
                    x = at[x]
                return x

            for a, b in pairs:
                at[root(a)] = root(40 + b)
            return [[root(x) == root(y) for y in range(100)] for x in range(100)]

        assert parts(zip(i, j)) == parts(zip(*np.nonzero(hit)))
