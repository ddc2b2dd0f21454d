"""Listings, facets, details and coverage of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(rows: DataFrame, where: Column | None = None) -> DataFrame:
    return (rows if where is None else rows.where(where)).agg(F.count(F.lit(1)).alias("n"))


def category_facets(items: DataFrame, limit: int | None = None) -> DataFrame:
    out = items.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    return out if limit is None else out.limit(limit)


def tag_facets(rows: DataFrame, nonblank: bool = False, contains: str = "", limit: int | None = None) -> DataFrame:
    """Rows per tag; a tag twice in a row counts twice. Nulls and empty arrays have no tags."""
    tags = rows.select(F.explode("tags").alias("tag"))
    if nonblank:
        tags = tags.where(F.trim("tag") != "")
    if contains.strip():
        tags = tags.where(F.contains(F.lower("tag"), F.lit(contains.strip().lower())))
    out = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")
    return out if limit is None else out.limit(limit)


def popularity(attempts: DataFrame, peers: DataFrame) -> DataFrame:
    """(work_id, items, seeders, leechers, popularity): items that matching has tied to a work and their peers."""
    tied = attempts.where(F.col("work_id").isNotNull()).select("item_id", "work_id").join(peers, "item_id", "left")
    seeders, leechers = (F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in ("seeders", "leechers"))
    return tied.groupBy("work_id").agg(F.count(F.lit(1)).alias("items"), seeders.alias("seeders"), leechers.alias("leechers")).withColumn("popularity", F.col("seeders") + F.col("leechers"))


#: Which image is taken first, by entity and view.
IMAGE_ORDERS = {
    "works": ("background_url", "image_url", "poster_url"),
    "sites": ("poster_url", "logo_url"),
    "networks": ("poster_url", "logo_url"),
    "people": ("image_url", "face_url", "thumbnail_url"),
    "cast": ("face_url", "thumbnail_url", "image_url"),
}


def first_image(view: str) -> Column:
    """The first of a view's images that isn't null."""
    return F.coalesce(*IMAGE_ORDERS[view])


def work_cards(works: DataFrame, sites: DataFrame, bridge: DataFrame, attempts: DataFrame, peers: DataFrame) -> DataFrame:
    """(id, title, date, image_url, secondary, related_count, items, popularity): aggregated before the joins, zero where nothing is."""
    cast = bridge.groupBy("work_id").agg(F.count(F.lit(1)).alias("cast"))
    joined = works.join(cast, "work_id", "left").join(popularity(attempts, peers).select("work_id", "items", "popularity"), "work_id", "left")
    joined = joined.join(sites.select("site_id", F.col("name").alias("site_name")), "site_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        F.col("work_id").alias("id"), "title", "date", first_image("works").alias("image_url"), F.col("site_name").alias("secondary"), zero("cast").alias("related_count"), zero("items").alias("items"), zero("popularity").alias("popularity")
    )


def related_cards(entity: str, rows: DataFrame, key: str, children: DataFrame, child: str, secondary: Column | None = None, date: Column | None = None) -> DataFrame:
    """(id, name, date, image_url, secondary, related_count) of sites, networks or people with their distinct children."""
    counts = children.groupBy(key).agg(F.count_distinct(child).alias("n"))
    date = F.lit(None).cast("date") if date is None else date
    secondary = F.lit(None).cast("string") if secondary is None else secondary
    return rows.join(counts, key, "left").select(F.col(key).alias("id"), "name", date.alias("date"), first_image(entity).alias("image_url"), secondary.alias("secondary"), F.coalesce("n", F.lit(0)).alias("related_count"))


def merged_images(*sources: Column) -> Column:
    """Images of single columns and arrays, first-seen order, without nulls, blanks and repeats."""
    return F.array_distinct(F.filter(F.flatten(F.array(*sources)), lambda u: u.isNotNull() & (u != "")))


def _listed(value: Column) -> Column:
    """URLs of a JSON list whose entries are texts or objects with a ``url``; others are left out."""
    entries = F.from_json(F.when(F.try_parse_json(value).isNotNull(), value), "array<variant>")

    def url(entry):
        own = F.when(F.schema_of_variant(entry) == "STRING", entry)
        of = F.try_variant_get(entry, "$.url", "variant")
        return F.coalesce(own, F.when(F.schema_of_variant(of) == "STRING", of)).cast("string")

    return F.coalesce(F.transform(entries, url), F.array().cast("array<string>"))


def _texts(json: Column, at: str) -> Column:
    """The text at a path of a JSON text as an array; nothing if it is no text."""
    value = F.try_variant_get(F.try_parse_json(json), at, "variant")
    return F.array(F.when(F.schema_of_variant(value) == "STRING", value.cast("string")))


def person_images() -> Column:
    """All images of a person: own columns, posters, and those of the profiles in the metadata, each once."""
    sources = [F.array("image_url", "face_url", "thumbnail_url"), _listed(F.col("posters"))]
    for profile in ("profile", "site_profile"):
        sources += [_texts(F.col("metadata"), f"$.{profile}.{c}") for c in ("image", "face", "thumbnail")]
        sources.append(_listed(F.try_variant_get(F.try_parse_json("metadata"), f"$.{profile}.posters", "string")))
    return merged_images(*sources)


def item_images(items: DataFrame, order: list[Column]) -> DataFrame:
    """One row with ``images``: those of all items, in their order, each once; ``items`` are those of one work."""
    placed = items.select(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.concat(F.array("image_url"), F.coalesce("images", F.array().cast("array<string>"))).alias("own"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("o", "own"))), lambda x: x["own"])
    return placed.agg(merged_images(F.flatten(in_order)).alias("images"))


def work_link(works: DataFrame) -> DataFrame:
    """(id, name, date, image_url) of works."""
    return works.select(F.col("work_id").alias("id"), F.col("title").alias("name"), "date", first_image("works").alias("image_url"))


def latest_works(works: DataFrame, limit: int = 48) -> DataFrame:
    """The newest works, those without a date last."""
    return work_link(works).orderBy(F.desc_nulls_last("date"), F.asc("id")).limit(limit)


@dataclass(frozen=True)
class Detail:
    """An entity's row and what belongs to it."""

    row: DataFrame
    parts: dict[str, DataFrame]


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; ``KeyError`` if there is none."""
    found = rows.where(F.col(key) == value)
    if not found.limit(1).count():
        raise KeyError(f"{key} {value}")
    return found


def item_detail(items: DataFrame, attempts: DataFrame, works: DataFrame, sites: DataFrame) -> DataFrame:
    """Items with the work that a match ties them to, as a struct, null without one."""
    matched = attempts.where("status = 'matched'").select("item_id", "work_id").join(works, "work_id").join(sites.select("site_id", F.col("name").alias("site_name")), "site_id", "left")
    matched = matched.select("item_id", F.struct("work_id", "title", "site_name").alias("matched_work"))
    return items.join(matched, "item_id", "left")


def work_detail(key, works, sites, networks, people, bridge, items, attempts) -> Detail:
    """A work with its people as billed, its items, the largest first, and the items' images."""
    site = sites.select("site_id", "network_id", F.col("name").alias("site_name"))
    network = networks.select("network_id", F.col("name").alias("network_name"))
    row = one(works, "work_id", key).join(site, "site_id", "left").join(network, "network_id", "left")
    cast = bridge.where(F.col("work_id") == key).join(people, "person_id").orderBy("ordinal", "person_id")
    cast = cast.select(F.col("person_id").alias("id"), "name", first_image("cast").alias("image_url"), "ordinal")
    own = items.join(attempts.where(F.col("work_id") == key).select("item_id"), "item_id")
    order = [F.desc_nulls_last("size_bytes"), F.asc("item_id")]
    images = item_images(own, [F.col("size_bytes").isNull(), -F.col("size_bytes"), F.col("item_id")])
    return Detail(row, {"people": cast, "items": own.orderBy(*order), "images": images})


def site_detail(key, sites, networks, works) -> Detail:
    row = one(sites, "site_id", key).join(networks.select("network_id", F.col("name").alias("network_name")), "network_id", "left")
    return Detail(row, {"works": latest_works(works.where(F.col("site_id") == key))})


def network_detail(key, networks, sites, works) -> Detail:
    own = sites.where(F.col("network_id") == key)
    recent = works.join(own.select("site_id"), "site_id", "left_semi")
    return Detail(one(networks, "network_id", key), {"sites": own.orderBy("name", "site_id"), "works": latest_works(recent)})


def person_detail(key, people, bridge, works) -> Detail:
    """A person with all images merged into ``images``, and the newest works."""
    own = works.join(bridge.where(F.col("person_id") == key).select("work_id"), "work_id", "left_semi")
    return Detail(one(people, "person_id", key).withColumn("images", person_images()), {"works": latest_works(own)})


def coverage(items: DataFrame, attempts: DataFrame, categories: list[str]) -> DataFrame:
    """One row: how many eligible items were tried, and with what outcome, in one pass."""
    eligible = F.col("category").isin(categories)
    joined = items.select("item_id", "category").join(attempts.select("item_id", "status"), "item_id", "left")
    counts = [F.count_if(eligible).alias("eligible"), F.count(F.when(eligible, F.col("status"))).alias("attempted")]
    counts += [F.count_if(eligible & (F.col("status") == s)).alias(s) for s in ("matched", "unmatched", "error", "no_file")]
    out = joined.agg(*counts)
    rate = F.when(F.col("attempted") > 0, F.col("matched") / F.col("attempted") * 100).otherwise(0.0)
    return out.withColumns({"pending": F.greatest(F.lit(0), F.col("eligible") - F.col("attempted")), "match_rate": F.round(rate, 4)})


def outcome_tally(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of each status, zero for those that don't occur."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses]).select(F.explode(F.map_from_arrays(F.lit(statuses), F.array(*statuses))).alias("status", "n"))


def probe_summary(log: DataFrame) -> DataFrame:
    """Requests, successes and failures per host, and what the two extremes say of the rate."""
    by = log.groupBy("host").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("failed"))
    all_ok, some_ok = F.col("failed") == 0, F.col("ok") > 0
    return by.withColumn("verdict", F.when(all_ok, "raise the rate").when(some_ok, "keep the rate").otherwise("lower the rate"))
