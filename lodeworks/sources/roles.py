"""The catalogue's tables as views of the generic input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pictures(key: str, prefix: str, **each: int) -> list:
    """Picture columns: a name for keys that the number divides, null for others."""
    return [F.when(F.col(key) % n == 0, F.concat(F.lit(f"{prefix}-{c[0]}-"), F.col(key))).alias(c) for c, n in each.items()]


def _pictures_sql(key: str, prefix: str, **each: int) -> str:
    return ", ".join(f"CASE WHEN {key} % {n} = 0 THEN '{prefix}-{c[0]}-' || {key} END AS {c}" for c, n in each.items())


class Roles:
    """networks, sites, works, people, bridge, items, attempts, tags and fetch log of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def networks(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("bigint").alias("network_id"), F.col("r_name").alias("name"), *_pictures("r_regionkey", "n", poster_url=2, logo_url=1))

    @property
    def sites(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("site_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("network_id"), *_pictures("n_nationkey", "s", poster_url=3, logo_url=2))

    @property
    def works(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("work_id"),
            F.col("c_name").alias("title"),
            F.col("c_nationkey").cast("bigint").alias("site_id"),
            F.col("c_acctbal").alias("rating"),
            F.col("c_mktsegment").alias("type"),
            F.when(F.col("c_custkey") % 11 > 0, F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") * 37 % 9000).cast("int"))).alias("date"),
            F.array(F.col("c_mktsegment"), F.concat(F.lit("area "), F.col("c_nationkey") % 5)).alias("tags"),
            *_pictures("c_custkey", "w", background_url=5, image_url=3, poster_url=2),
        )

    @property
    def people(self) -> DataFrame:
        k = F.col("s_suppkey")
        url = lambda name: F.concat(F.lit(name), k)
        profile = F.struct(url("img").alias("image"), url("pf").alias("face"), F.array(F.struct(url("pp").alias("url"))).alias("posters"))
        metadata = F.struct(profile.alias("profile"), F.struct(url("st").alias("thumbnail"), F.lit(7).alias("image")).alias("site_profile"))
        return self.table("supplier").select(
            k.alias("person_id"),
            F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("rating"),
            F.when(k % 7 > 0, F.date_add(F.lit("1960-01-01").cast("date"), (k * 53 % 15000).cast("int"))).alias("date"),
            F.concat(F.lit("N"), F.col("s_nationkey")).alias("nationality"),
            *_pictures("s_suppkey", "img", image_url=3),
            *_pictures("s_suppkey", "f", face_url=2),
            *_pictures("s_suppkey", "t", thumbnail_url=1),
            F.concat(F.lit('["img'), k, F.lit('", {"url": "post'), k, F.lit('"}, 5, "", null]')).alias("posters"),
            F.when(k % 4 > 0, F.to_json(metadata)).otherwise("no json").alias("metadata"),
        )

    @property
    def items(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("item_id"),
            F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" "), F.col("o_orderstatus")).alias("title"),
            F.concat(F.lit("user"), F.col("o_custkey") % 97).alias("uploader"),
            F.col("o_orderpriority").alias("category"),
            F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
            F.to_date("o_orderdate").alias("added_at"),
            F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderkey") % 1000).alias("downloads"),
            F.array(F.col("o_orderstatus"), F.concat(F.lit("clerk "), F.col("o_custkey") % 7)).alias("tags"),
            *_pictures("o_orderkey", "i", image_url=4),
            F.array(F.concat(F.lit("i"), F.col("o_orderkey")), F.concat(F.lit("shot"), F.col("o_custkey") % 9)).alias("images"),
            F.concat(F.lit("magnet:?xt=urn:btih:"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 40)).alias("magnet"),
        )

    @property
    def listed_items(self) -> DataFrame:
        """Items with their peers, as listings show them."""
        return self.items.join(self.peers, "item_id", "left")

    @property
    def attempts(self) -> DataFrame:
        """What matching has said of each item so far."""
        status = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "unmatched").otherwise("error")
        return self.table("orders").select(
            F.col("o_orderkey").alias("item_id"),
            F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 17 > 0), F.col("o_custkey")).alias("work_id"),
            status.alias("status"),
            F.concat(F.lit("k"), F.col("o_custkey") % 500).alias("group_key"),
            (F.col("o_orderkey") % 8).cast("int").alias("attempts"),
            F.to_date("o_orderdate").alias("attempted_at"),
            F.when(F.col("o_orderstatus") != "F", F.date_add(F.to_date("o_orderdate"), F.col("o_orderkey").cast("int") % 30)).alias("next_retry_at"),
            F.when(F.col("o_orderkey") % 5 > 0, F.round(F.col("o_totalprice") / 500000, 4)).alias("match_score"),
            F.when(F.col("o_orderkey") % 7 == 0, "resolution_sibling").when(F.col("o_orderkey") % 11 == 0, "parse_filename_first").otherwise("search").alias("method"),
        )

    @property
    def peers(self) -> DataFrame:
        """Seeders and leechers of items; some items have no row."""
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.sum("l_quantity").cast("bigint").alias("seeders"), F.sum("l_linenumber").cast("bigint").alias("leechers"))

    @property
    def bridge(self) -> DataFrame:
        """People of works, with the order in which they are billed."""
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("work_id"), F.col("l_suppkey").alias("person_id")).agg(F.min("l_linenumber").alias("ordinal"))

    @property
    def tagged(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.split("p_name", " ").alias("tags"), F.col("p_brand").alias("title"), F.col("p_type").alias("uploader"))

    @property
    def fetch_log(self) -> DataFrame:
        """One request each: host, time, HTTP status and seconds a server asked to wait."""
        status = F.element_at(F.lit([200, 404, 429, 503, 302]), F.array_position(F.lit(["view", "click", "purchase", "signup", "error"]), F.col("event_type")).cast("int"))
        return self.table("events").select(
            F.col("event_id").alias("item_id"),
            F.col("user_id").alias("host"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
            status.alias("status"),
            F.when(F.col("event_id") % 9 == 0, F.col("event_id") % 200).alias("retry_after"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )


#: The same views for the SQL side, to be named in a WITH clause.
VIEWS = {
    "networks": "SELECT CAST(r_regionkey AS BIGINT) AS network_id, r_name AS name, " + _pictures_sql("r_regionkey", "n", poster_url=2, logo_url=1) + " FROM region",
    "sites": "SELECT CAST(n_nationkey AS BIGINT) AS site_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS network_id, " + _pictures_sql("n_nationkey", "s", poster_url=3, logo_url=2) + " FROM nation",
    "works": "SELECT c_custkey AS work_id, c_name AS title, CAST(c_nationkey AS BIGINT) AS site_id, c_acctbal AS rating, c_mktsegment AS type, CASE WHEN c_custkey % 11 > 0 THEN DATE '2000-01-01' + CAST(c_custkey * 37 % 9000 AS INTEGER) END AS date, [c_mktsegment, 'area ' || (c_nationkey % 5)] AS tags, " + _pictures_sql("c_custkey", "w", background_url=5, image_url=3, poster_url=2) + " FROM customer",
    "people": "SELECT s_suppkey AS person_id, s_name AS name, s_acctbal AS rating, CASE WHEN s_suppkey % 7 > 0 THEN DATE '1960-01-01' + CAST(s_suppkey * 53 % 15000 AS INTEGER) END AS date, 'N' || s_nationkey AS nationality, " + ", ".join(_pictures_sql("s_suppkey", p, **{c: n}) for p, c, n in (("img", "image_url", 3), ("f", "face_url", 2), ("t", "thumbnail_url", 1))) + " FROM supplier",
    "items": "SELECT o_orderkey AS item_id, 'Order ' || o_orderkey || ' ' || o_orderstatus AS title, 'user' || (o_custkey % 97) AS uploader, o_orderpriority AS category, CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes, CAST(o_orderdate AS DATE) AS added_at, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 1000 END AS downloads, [o_orderstatus, 'clerk ' || (o_custkey % 7)] AS tags, " + _pictures_sql("o_orderkey", "i", image_url=4) + ", ['i' || o_orderkey, 'shot' || (o_custkey % 9)] AS images, 'magnet:?xt=urn:btih:' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 40) AS magnet FROM orders",
    "listed_items": "SELECT items.*, seeders, leechers FROM items LEFT JOIN peers USING (item_id)",
    "attempts": "SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 > 0 THEN o_custkey END AS work_id, CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'unmatched' ELSE 'error' END AS status, 'k' || (o_custkey % 500) AS group_key, CAST(o_orderkey % 8 AS INTEGER) AS attempts, CAST(o_orderdate AS DATE) AS attempted_at, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS next_retry_at, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 500000, 4) END AS match_score, CASE WHEN o_orderkey % 7 = 0 THEN 'resolution_sibling' WHEN o_orderkey % 11 = 0 THEN 'parse_filename_first' ELSE 'search' END AS method FROM orders",
    "peers": "SELECT l_orderkey AS item_id, CAST(sum(l_quantity) AS BIGINT) AS seeders, CAST(sum(l_linenumber) AS BIGINT) AS leechers FROM lineitem GROUP BY 1",
    "bridge": "SELECT o_custkey AS work_id, l_suppkey AS person_id, min(l_linenumber) AS ordinal FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "tagged": "SELECT p_partkey AS item_id, string_split(p_name, ' ') AS tags, p_brand AS title, p_type AS uploader FROM part",
    "fetch_log": "SELECT event_id AS item_id, user_id AS host, CAST(floor(epoch(ts)) AS BIGINT) AS \"at\", CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'purchase' THEN 429 WHEN 'signup' THEN 503 WHEN 'error' THEN 302 END AS status, CASE WHEN event_id % 9 = 0 THEN event_id % 200 END AS retry_after, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """SQL with the named views before it."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    more = sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{views}, {more[5:]}" if more.upper().startswith("WITH ") else f"{head}{views} {more}"
