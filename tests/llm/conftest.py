import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, ties, repeated rows, a very long text and columns with clashing names."""
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "a"), (None, "No id here.", None), (4, "Same text twice.", "a"), (4, "Same text twice.", "a"), (5, "Same text twice.", "b")]
    rows += [(6, "word " * 30_000, "a"), (7, "<|endoftext|>  ends\n\nit's", "c"), (8, "漢字 😀 ...", "c")]
    schema = "doc_id long, text string, source string"
    out = spark.createDataFrame(rows, schema)
    names = "fingerprint ids size label start shard slot node rows number spans span_doc span_text kept_id kept_text leaking text_key doc run known score lang_pred _id _key _spans _kept _leak".split()
    for name in names:
        out = out.selectExpr("*", f"'x' AS {name}")
    return out.selectExpr("*", "'en' AS lang", "length(text) + 0L AS n_chars")
