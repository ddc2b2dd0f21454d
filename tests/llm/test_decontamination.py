import random

import pytest
import regex as re

from lodeworks.llm import decontamination, queries

SF = "/root/testdata/sf0.01"


def _words(text):
    return decontamination.Items._words(text)


def test_subsequence_length_equals_the_table():
    r = random.Random(1)
    for _ in range(50):
        a = [r.choice("abcd") for _ in range(r.randint(1, 80))]
        b = [r.choice("abcde") for _ in range(r.randint(0, 90))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontamination.common_subsequence(masks, len(a), b) == row[-1]


def test_finds_what_whole_text_search_finds(spark):
    docs = [(r.doc_id, " " + " ".join(_words(r.text)) + " ") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, " " + " ".join(_words(r.text)) + " ") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, w in items if w in t}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    assert want and got == want


@pytest.fixture(scope="module")
def items(spark):
    text = "Who wrote the long poem about winter storms in the northern harbour towns? It was old Maria Kettle of Brund."
    return spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "...")], "item_id long, text string"), text


def test_paraphrases_need_the_answer(spark, items, docs):
    table, text = items
    other = [(r.doc_id + 100, r.text) for r in docs.collect()]
    half = "who wrote that very long poem about fierce winter storms in northern towns"
    rows = [*other, (1, f"Filler here. {text} More."), (2, f"Some {half} it was old Maria Kettle of Brund yes"), (3, f"Some {half} nobody knows"), (4, None), (5, "")]
    found = {r.doc_id: r for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), table, cosine=0.2).collect()}
    assert set(found) == {1, 2} and found[1].item_share == 1.0 and 0.6 <= found[2].item_share < 0.95


def test_odd_rows_and_empty_tables(spark, odd_docs, items):
    assert decontamination.leaks(odd_docs, items[0]).count() == 0
    assert decontamination.leaks(odd_docs.limit(0), items[0]).count() == 0
    assert decontamination.leaks(odd_docs, items[0].limit(0)).count() == 0


def test_words_end_at_punctuation_and_other_blanks(spark, items, docs):
    assert _words("one two—three four.Five six") == ["one", "two", "three", "four", "five", "six"]
    assert _words("漢字です。abc") == ["漢", "字", "で", "す", "abc"] and _words(" ... ") == [] and _words("") == []
    text = items[1]
    cjk = "北港的老瑪莉寫了一首關於冬天風暴的長詩那是誰寫的呢答案是瑪莉水壺"
    rows = [(r.doc_id + 100, r.text) for r in docs.collect()]
    rows += [(1, f"Filler here {text.replace(' ', '—')} more"), (2, text.replace(" ", "\u00a0")), (4, text.replace(" ", "\u3000")), (3, f"前文文字{cjk}後文文字")]
    table = items[0].unionAll(spark.createDataFrame([(9, cjk)], "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert found == {(1, 1), (2, 1), (4, 1), (3, 9)}


def test_short_items_within_other_text_are_found(spark):
    """Items of 8 to 16 words, verbatim, or with a third of the words changed and the answer kept, at random places."""
    r = random.Random(2)
    docs = [t.text for t in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").limit(600).collect()]
    pool = sorted({w for t in docs for w in _words(t)})
    common = sorted(pool, key=lambda w: (-sum(w in t for t in docs[:60]), w))[:300]
    items, rows = [], []
    for k in range(60):
        size = r.randint(8, 16)
        words = r.choices(common if k % 2 else pool, k=size)
        items.append((k, " ".join(words[:-3]) + ". " + " ".join(words[-3:])))
        drop = set(r.sample(range(size - 3), size // 3)) if k % 3 == 0 else set()
        host = docs[10 * k].split()
        at = r.randint(0, len(host))
        rows.append((k, " ".join([*host[:at], *("zzz" if n in drop else w for n, w in enumerate(words)), *host[at:]])))
    rows += [(1000 + n, t) for n, t in enumerate(docs)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()
    assert {(d, d) for d in range(60)} <= {(x.doc_id, x.item_id) for x in got}
    # with production parameters, such places have low cosines
    assert min(x.cosine for x in got if x.doc_id == x.item_id) < 0.3


def brute(docs, items, leak=0.8, paraphrase=0.6, answer=0.8):
    """Pairs of document and item, from the longest common subsequence at every place of every document."""
    found = set()
    size = decontamination.BLOCK
    for i, text in items:
        item = _words(text)
        if not item:
            continue
        sentences = [s for s in re.split(r"(?<=[.!?。！？])\s+|[\n\r]+", text) if _words(s)]

        def share(target, words):
            masks = {}
            for k, w in enumerate(target):
                masks[w] = masks.get(w, 0) | 1 << k
            return decontamination.common_subsequence(masks, len(target), words) / len(target)

        for d, words in docs:
            if sum(w in words[1] for w in item) < paraphrase * len(item):
                continue
            for b in range(0, len(words[0]), size):
                part = words[0][max(0, b - len(item)) : b + 2 * size + len(item)]
                got = share(item, part)
                if got >= leak or (got >= paraphrase and share(_words(sentences[-1]), part) >= answer):
                    found.add((d, i))
                    break
    return found


def _brute_rows(rows):
    return [(r.doc_id, (w, set(w))) for r in rows for w in [_words(r.text or "")]]


def test_query_equals_brute_force(spark, docs):
    """Every document against every item at every place, without rare words, cosines or blocks of items."""
    small = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, small).collect()}
    want = brute(_brute_rows(docs.collect()), items)
    assert want and got == want


def test_planted_paraphrases_equal_brute_force(spark, docs, monkeypatch):
    """Items of 15 to 60 words of the corpus, verbatim, with words replaced or left out, within other documents; many small slices."""
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 4_000)
    r = random.Random(6)
    texts = [t for t in (x.text for x in docs.orderBy("doc_id").collect()) if t and len(_words(t)) > 150]
    items, rows = [], [(10_000 + k, t) for k, t in enumerate(texts)]
    for k in range(80):
        words = r.choice(texts).split()
        size = r.randint(15, 60)
        at = r.randint(0, len(words) - size)
        own = words[at : at + size]
        items.append((k, " ".join(own[:-6]) + ". " + " ".join(own[-6:])))
        gone = r.choice([0, 0.1, 0.2, 0.35, 0.5])
        changed = [w if r.random() >= gone or (n >= size - 6 and k % 2) else r.choice(["", "zzz", r.choice(words)]) for n, w in enumerate(own)]
        host = r.choice(texts).split()
        at = r.randint(0, len(host))
        rows.append((k, " ".join([*host[:at], *(w for w in changed if w), *host[at:]])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(_brute_rows(table.collect()), items)
    planted = {(k, k) for k in range(80)} & want
    assert len(planted) > 50 and got == want


def test_ties_repeated_rows_and_a_late_passage(spark, items):
    table, text = items
    rows = [(1, text), (1, text), (2, f"{text} and again {text}"), (3, "filler words go on here " * 20_000 + text)]
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), table.unionAll(table.where("item_id = 1").selectExpr("77L", "text"))).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 1), (1, 1), (1, 77), (1, 77), (2, 1), (2, 77), (3, 1), (3, 77)]
    assert all(x.first_word < 60 for x in got if x.doc_id == 2) and all(x.first_word > 90_000 for x in got if x.doc_id == 3)
