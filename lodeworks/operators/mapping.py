"""Candidate lists and nested work records to catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import iso_date

ORG = "id:bigint, uuid:string, name:string, short_name:string, network_id:bigint"
PERSON = "id:bigint, _id:string, name:string, extras:struct<birthday:string,gender:string>"
WORK = (
    f"id string, _id bigint, title string, date string, url string, duration bigint, site struct<{ORG},network:struct<{ORG}>,parent:struct<{ORG}>>, "
    f"performers array<struct<{PERSON},parent:struct<{PERSON}>>>, tags array<struct<name:string>>"
)


def candidate_rows(answers: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Rows of candidate lists ``{data: [...], meta: {total}}``, in order; a list without data is an error row.

    ``total`` falls back to the number of candidates.
    """
    read = F.from_json(F.col(raw), "data array<string>, meta struct<total:bigint>")
    out = answers.withColumn("_read", read)
    data = F.col("_read.data")
    total = F.coalesce(F.col("_read.meta.total"), F.size(data).cast("bigint"))
    out = out.withColumns({"total": F.when(data.isNotNull(), total), "error": data.isNull()})
    return out.select(*answers.columns, "total", "error", F.posexplode_outer(data).alias("pos", "candidate")).drop(raw)


def read_works(rows: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Records read by schema; those without id, number or title are errors."""
    read = rows.withColumn("w", F.from_json(raw, WORK))
    return read.withColumn("error", F.col("w.id").isNull() | F.col("w._id").isNull() | F.coalesce(F.col("w.title") == "", F.lit(True)))


def bundle(rows: DataFrame, raw: str = "raw_json") -> dict[str, DataFrame]:
    """networks, sites, works, people and bridge of work records, each key once.

    A site's network is its own record or a parent of that id; a person is the parent profile if it has an id.
    """
    good = read_works(rows, raw).where("not error")
    site = F.col("w.site")
    network = F.when(site["network"]["id"].isNotNull(), site["network"]).when(site["parent"]["id"] == site["network_id"], site["parent"])
    networks = good.select(network.alias("n")).where("n.id IS NOT NULL").select(F.col("n.id").alias("network_id"), "n.uuid", "n.name").dropDuplicates(["network_id"])
    sites = good.where(site["id"].isNotNull()).select(site["id"].alias("site_id"), site["uuid"].alias("uuid"), site["name"].alias("name"), F.coalesce(site["network_id"], network["id"]).alias("network_id"))
    tags = F.transform(F.filter("w.tags", lambda t: F.coalesce(t["name"] != "", F.lit(False))), lambda t: t["name"])
    works = good.select(F.col("w.id").alias("work_id"), F.col("w._id").alias("number"), F.col("w.title").alias("title"), iso_date(F.col("w.date")).alias("date"), site["id"].alias("site_id"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    cast = good.select(F.col("w.id").alias("work_id"), F.posexplode("w.performers").alias("pos", "p"))
    plain = F.struct(*[F.col(f"p.{c}").alias(c) for c in ("id", "_id", "name", "extras")])
    profile = F.when(F.col("p.parent.id").isNotNull(), F.col("p.parent")).otherwise(plain)
    cast = cast.select("work_id", "pos", profile.alias("p")).where("p.id IS NOT NULL")
    people = cast.select(F.col("p.id").alias("person_id"), "p.name", iso_date(F.col("p.extras.birthday")).alias("birth_date")).dropDuplicates(["person_id"])
    bridge = cast.groupBy("work_id", F.col("p.id").alias("person_id")).agg(F.min("pos").alias("ordinal"))
    return {"networks": networks, "sites": sites.dropDuplicates(["site_id"]), "works": works.dropDuplicates(["work_id"]), "people": people, "bridge": bridge}
