import collections
import random
import re

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lodeworks.llm import queries, sentence_spans

SF = "/root/testdata/sf0.001"


def parts_of(text):
    """Ends of the parts of a text, word by word."""
    if not text:
        return [len(text)]
    found = list(re.finditer("[ก-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|[^\\s\x00\x01ก-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+", text))
    rank = [int.from_bytes(xxhash.xxh3_128_digest(m[0].lower())[:8], "little") for m in found]
    sentence, at = [], 0
    for k, m in enumerate(found):
        sentence.append(at)
        gap = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
        at += bool(re.search("[.!?。！？][\"'»”’)\\]]*$", m[0]) or re.search("[\n\r\u2028\u2029]", gap))
    out = []
    for k in range(1, len(found)):
        near = range(k - 3, k + 2)
        least = near[0] >= 0 and near[-1] < len(found) and len({sentence[i] for i in near}) == 1 and rank[k - 1] == min(rank[i] for i in near)
        if sentence[k] != sentence[k - 1] or least:
            out.append(found[k].start())
    return [*out, len(text)]


def words_of(text):
    return [m[0].lower() for m in re.finditer("[ก-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]|[^\\s\x00\x01ก-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]+", text)]


def brute(docs, min_words):
    """doc_id, text -> what stays, from all runs of the documents in the order of ids."""
    seen, covered = {}, collections.defaultdict(set)
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    for doc, text in ordered:
        ends = parts_of(text or "")
        parts = [words_of((text or "")[a:b]) for a, b in zip([0, *ends], ends)]
        pairs = set()
        for i in range(len(parts)):
            for j in range(i + 1, len(parts)):
                if sum(map(len, parts[i : j + 1])) >= min_words:
                    pairs.add((i, j))
                    break
        for j in range(len(parts)):
            for i in range(j - 1, -1, -1):
                if sum(map(len, parts[i : j + 1])) >= min_words:
                    pairs.add((i, j))
                    break
        own = set()
        for i, j in sorted(pairs):
            key = tuple(w for p in parts[i : j + 1] for w in p)
            if key in own or seen.get(key, (doc,))[0] != doc:
                covered[doc, text] |= set(range(i, j + 1))
            own.add(key)
            seen.setdefault(key, (doc,))
    out = {}
    for (doc, text), gone in covered.items():
        ends = parts_of(text)
        out[doc, text] = "".join(text[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in gone)
    return out


def test_parts_equal_those_found_word_by_word(docs):
    texts = ["", " \n ", "One.", "Ein Haus! Das \"große\" Haus.) Ende", "漢字です。次の文です！終わり\u3000又は", "a\x01b\x00c\u2028d e f g h i j", "\n\nx y\r\nz", "insh " * 40]
    texts += [r.text for r in docs.collect()]
    assert [ends for ends, _ in sentence_spans.run_places(texts, 30)] == [parts_of(t) for t in texts]


@given(st.lists(st.text(alphabet="ab C.!?\n\u3000漢。\u00a0\x01\x1dé\"", max_size=60), max_size=4))
def test_parts_of_any_text(texts):
    assert [ends for ends, _ in sentence_spans.run_places(texts, 30)] == [parts_of(t) for t in texts]


def test_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 30)
    got = {r.doc_id: r.text for r in sentence_spans.dedup(docs).collect()}
    assert got == {d: want.get((d, t), t) for d, t in rows}
    spans = queries.op7_substring_dedup(spark, SF).collect()
    assert {r.doc_id for r in spans} == {d for d, _ in want} and want
    text = dict(rows)
    assert all(text[r.doc_id][r.begin : r.end] == r.removed and all(f <= r.doc_id for f in r.first_doc_ids) for r in spans)


def test_passage_within_other_sentences(spark):
    a = "Ab cd ef. " + "Uno dos tres cuatro cinco seis siete ocho nueve diez. " * 1
    passage = "Alpha one two three four five six seven eight nine. Beta ten eleven twelve thirteen fourteen. Gamma " + " ".join(f"w{i}" for i in range(40)) + "."
    rows = [(1, f"Here it starts {passage} and goes on."), (2, f"{a}Then {passage} other end. Last words stay."), (3, "Clean text stays. As it is.")]
    got = {r.doc_id: r.text for r in sentence_spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows, 30)
    assert got == {d: want.get((d, t), t) for d, t in rows}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    head, tail = got[2].split("Then ")  # up to a few words of the passage stay where it begins within a sentence
    assert head == a and tail.endswith(" other end. Last words stay.") and passage.startswith(tail.removesuffix("other end. Last words stay.")) and len(tail.split()) < 13


def test_many_slices_of_a_batch(spark, docs, monkeypatch):
    monkeypatch.setattr(sentence_spans, "SLICE_BYTES", 2_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 30)
    assert {r.doc_id: r.text for r in sentence_spans.dedup(docs.coalesce(1)).collect()} == {d: want.get((d, t), t) for d, t in rows}


def test_odd_rows_and_empty_table(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = sentence_spans.dedup(odd_docs, min_words=3)
    assert out.columns == odd_docs.columns and out.count() == len(rows)
    want = brute(rows, 3)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((d, want.get((d, t), t)) for d, t in rows), key=str)
    assert sentence_spans.dedup(odd_docs.limit(0)).count() == 0
    assert sentence_spans.removed_spans(odd_docs.limit(0)).count() == 0


def test_passages_cut_at_random_words(spark):
    """Of passages of 51 to 120 words, set between words of two other documents each, all are found."""
    r = random.Random(3)
    pool = ["".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(w + (r.choice([".", ",", ""]) if r.random() < 0.1 else "") for w in r.choices(pool, k=n))

    rows, passages = [], []
    for k in range(200):
        passages.append(prose(r.choice([51, 55, 60, 80, 120])))
        rows += [(2 * k + n, f"{prose(90)} {passages[-1]} {prose(90)}") for n in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in sentence_spans.removed_spans(docs).collect()}
    assert set(found) == {2 * k + 1 for k in range(200)}
    text = dict(rows)
    for d, x in found.items():
        assert x.first_doc_ids == [d - 1] and x.removed.strip() in passages[d // 2] and x.removed == text[d][x.begin : x.end]
        assert len(x.removed.split()) >= 30
    assert sum(len(x.removed) for x in found.values()) > 0.85 * sum(map(len, passages))


def test_one_word_repeated_is_found(spark):
    docs = spark.createDataFrame([(1, "Start of it " + "insh " * 60), (2, "other words here " + "insh " * 60)], "doc_id long, text string")
    assert {x.doc_id for x in sentence_spans.removed_spans(docs).collect()} >= {2}
