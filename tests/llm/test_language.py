import zlib

from pyspark.sql import functions as F

from lodeworks.llm import language, queries


def test_held_out_accuracy(spark):
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, lang[r.doc_id][1])))
    held = [r.lang_pred == lang[r.doc_id][0] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_odd_rows_and_empty_table(spark, odd_docs):
    model = language.train([("the word is same", "en"), ("le mot est même", "fr")], 2)
    rows = {r.doc_id: r for r in language.predicted(odd_docs.withColumn("score", odd_docs.doc_id), model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred == "en" and rows[8].lang_pred != "und"
    assert language.predicted(odd_docs.limit(0), model).count() == 0
    none = language.fit(odd_docs.limit(0), odd_docs.doc_id > 0)
    assert {r.lang_pred for r in language.predicted(odd_docs, none).collect()} == {"und"}


def test_scores_equal_the_kernel_form():
    """The folded product equals the kernel with each landmark, computed from sets."""
    texts = [("alpha beta gamma", "a"), ("gamma delta eps", "a"), ("uno dos tres", "b"), ("cuatro cinco", "b")]
    model = language.train(texts, 2)
    tables = model.tables()
    got = model.predict(["alpha dos", "12 !", "tres tres"], tables)
    assert got[0] == ["a", "und", "b"] and got[1][1] == 0
    one, _, _ = model.presence(["alpha dos"], *tables)
    grams = lambda t: {f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    known = set().union(*(grams(t) for t, _ in texts))
    both = [len(grams("alpha dos") & grams(t)) for t, _ in texts]
    own = len(grams("alpha dos") & known)
    rows, _, _ = model.presence([t for t, _ in texts], *tables)
    for k, (t, _) in enumerate(texts):
        assert abs((one @ rows.T)[0, k] - both[k] / (own * len(grams(t))) ** 0.5) < 1e-5


def brute(model, text):
    """Scores of one text from its set of n-grams, without tables or matrices."""
    runs = "".join(c if c.isalpha() else "\0" for c in f" {text} ")
    while "\0\0" in runs:
        runs = runs.replace("\0\0", "\0")
    upper = {c.upper(): k + 2 for k, c in enumerate(model.alphabet) if len(c.upper()) == 1}
    symbol = {c: k + 2 for k, c in enumerate(model.alphabet)} | upper
    own = [0 if c == "\0" else symbol.get(c, 1) for c in runs]
    codes = set()
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            code = 0
            for x in own[i : i + n]:
                code = code << language.BITS | x
            codes.add(code + sum(1 << language.BITS * (m + 1) for m in range(n - 1)))
    place = {int(c): k for k, c in enumerate(model.codes)}
    there = [place[c] for c in codes if c in place]
    return model.bias + sum(model.weights[k].astype(float) for k in there) / max(1, len(there)) ** 0.5


def test_query_equals_brute_force(spark, docs):
    """Every row's language and score, one text and n-gram at a time."""
    model = language.fit(docs, queries.training_rows(), per_language=1000, landmarks=64)
    got = {r.doc_id: r for r in queries.op10_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        scores = brute(model, r.text or "")
        if got[r.doc_id].lang_pred == "und":
            assert not any(map(str.isalpha, r.text or ""))
            continue
        assert abs(got[r.doc_id].score - min(1, max(0, scores.max()))) < 1e-4
        assert scores[model.languages.index(got[r.doc_id].lang_pred)] > scores.max() - 1e-4


def test_sample_is_bounded_by_bytes_and_languages(spark, docs):
    rows = docs.withColumn("lang", F.when(docs.doc_id < 190, "en").otherwise(F.concat(F.lit("l"), docs.doc_id)))
    assert language.fit(rows, F.lit(True), languages=3).languages[0] == "en" and len(language.fit(rows, F.lit(True), languages=3).languages) <= 3
    seen = []
    real, language.train = language.train, lambda samples, landmarks: seen.append(sum(len(t) for t, _ in samples))
    try:
        language.fit(docs.withColumn("lang", F.lit("en")), F.lit(True), language_bytes=50_000)
        language.fit(docs.withColumn("lang", F.lit("en")), F.lit(True))
    finally:
        language.train = real
    assert 0 < seen[0] < 100_000 < seen[1]


def test_foreign_scripts_lie_below_the_floor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, queries.training_rows(), per_language=1000, landmarks=64)
    foreign = ["Это длинный русский текст, который модель никогда не видела.", "これは日本語の文章です。", "Αυτό είναι ένα ελληνικό κείμενο", "هذا نص عربي لم يره النموذج"]
    _, _, known = model.predict(foreign, model.tables())
    assert model.floor > 0 and (known < model.floor).all()
    least = language.predicted(docs, model).where("lang_pred <> 'und'").agg(F.min("known")).first()[0]
    assert least >= model.floor


def test_many_slices_and_a_very_long_text(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "PART_BYTES", 2_000)
    rows = [("the word is same " * 20_000, "en"), ("le mot est même " * 20_000, "fr"), ("the word", "en"), ("le mot", "fr")]
    model = language.train(rows, 2)
    table = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows * 30)], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id % 4, r.lang_pred) for r in language.predicted(table, model).collect()} == {(k, lang) for k, (_, lang) in enumerate(rows)}
