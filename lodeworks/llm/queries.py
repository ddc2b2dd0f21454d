"""One query for each operator of this package, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import ball_tree, decontamination, language, license_scan, packing, sentence_spans, sharding, simhash, token_counts, url_filter
from lodeworks.llm.common import new_path, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after inserts, deletes and revisions of whole groups.

    All documents are inserted, those of one language deleted, then inserted again, those of another
    revised by themselves, and the first batch is sent once more; so the totals are those of all documents.
    """
    rollup = token_counts.TokenRollup(spark, new_path(spark, "token_counts"), {"byte_bpe_50k@1": tokenizer_path()})
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")

    def changes(op: str, lang: str | None = None) -> DataFrame:
        return (docs if lang is None else docs.where(F.col("lang") == lang)).withColumn("op", F.lit(op))

    rollup.commit("load", changes("insert"))
    rollup.commit("withdrawn", changes("delete", "es"))
    rollup.commit("returned", changes("insert", "es"))
    rollup.commit("revised", changes("revise", "fr"))
    rollup.commit("load", changes("insert"))
    return rollup.totals()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents that states a licence."""
    return license_scan.scan(read(spark, sf_dir, "documents"), max_negatives=500)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that repeats one of a document before."""
    return sentence_spans.removed_spans(read(spark, sf_dir, "documents"), min_words=30)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    rows = sharding.shard(read(spark, sf_dir, "documents"), shards=16, slots=4096).rows
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return ball_tree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def training_rows() -> Column:
    """Documents from which languages may be learnt; the others of them are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs, training_rows(), per_language=1000, landmarks=64)
    held_out = F.coalesce(~training_rows(), F.lit(False)).alias("held_out")
    return language.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
}
#: Byte-pair tokens, XXH64 fingerprints, fitted models and span hashes have no SQL form.
ORACLES: dict[str, str] = {
    "op9_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5""",
}
