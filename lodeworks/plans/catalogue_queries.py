"""Listings, facets, details, coverage and matching over the role views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.catalogue import Catalogue
from lodeworks.functions import text
from lodeworks.operators import catalogue, matching, scan, selection
from lodeworks.plans.registry import query
from lodeworks.sources.roles import Roles, with_views

CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
IN_CATEGORIES = "('1-URGENT', '2-HIGH', '3-MEDIUM')"
AS_OF = "1998-06-01"
WORK_IMAGE = "coalesce(w.background_url, w.image_url, w.poster_url)"
POPULAR = f"""pop AS (SELECT a.work_id, count(*) AS items, CAST(sum(coalesce(p.seeders, 0) + coalesce(p.leechers, 0)) AS BIGINT) AS popularity FROM attempts a LEFT JOIN peers p USING (item_id) WHERE a.work_id IS NOT NULL GROUP BY 1),
 cards AS (SELECT w.work_id AS id, w.title, w.date, {WORK_IMAGE} AS image_url, s.name AS secondary, coalesce(c.n, 0) AS related_count, coalesce(pop.items, 0) AS items, coalesce(pop.popularity, 0) AS popularity, w.tags AS own_tags
  FROM works w LEFT JOIN (SELECT work_id, count(*) AS n FROM bridge GROUP BY 1) c USING (work_id) LEFT JOIN pop USING (work_id) LEFT JOIN sites s USING (site_id))"""
CARD_VIEWS = "works sites bridge attempts peers"


@query(with_views(CARD_VIEWS, f"WITH {POPULAR} SELECT * EXCLUDE (own_tags) FROM cards ORDER BY popularity DESC NULLS LAST, date DESC NULLS LAST, title NULLS LAST, id LIMIT 24"))
def works_popularity_page(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("works").records


@query(with_views(CARD_VIEWS, f"WITH {POPULAR} SELECT * EXCLUDE (own_tags) FROM cards WHERE title ILIKE '%customer%1%' AND list_contains(own_tags, 'area 2') ORDER BY date NULLS LAST, title NULLS LAST, id LIMIT 24"))
def works_oldest_tagged_page(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("works", " customer%1 ", "area 2", "oldest", "x").records


@query(with_views(CARD_VIEWS, f"WITH {POPULAR} SELECT * EXCLUDE (own_tags) FROM cards ORDER BY date DESC NULLS LAST, title NULLS LAST, id LIMIT 24 OFFSET 24"))
def works_newest_second_page(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("works", sort="newest", page="2").records


@query(with_views("works", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM works) WHERE trim(tag) <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 16"))
def work_tags(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("works").facets["tags"]


LISTED = "item_id, title, category, size_bytes, added_at, seeders, leechers, uploader, downloads, array_to_string(tags, ',') AS tags, image_url, magnet"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array_join("tags", ","))


@query(with_views("items peers listed_items", f"SELECT {LISTED} FROM listed_items ORDER BY added_at DESC NULLS LAST, item_id LIMIT 24"))
def items_default_page(r: Roles) -> DataFrame:
    return _flat(Catalogue(r).list_items(sort="no such order").records)


@query(with_views("items peers listed_items", f"SELECT {LISTED} FROM listed_items WHERE list_contains(tags, 'clerk 3') AND (title ILIKE '%1%' OR uploader ILIKE '%1%') AND category = '2-HIGH' ORDER BY seeders DESC NULLS LAST, item_id LIMIT 24"))
def items_by_seeders(r: Roles) -> DataFrame:
    return _flat(Catalogue(r).list_items("1", "2-HIGH", "clerk 3", "seeders").records)


@query(with_views("items peers listed_items", f"SELECT {LISTED} FROM listed_items ORDER BY downloads DESC NULLS LAST, item_id LIMIT 24 OFFSET 48"))
def items_by_downloads(r: Roles) -> DataFrame:
    return _flat(Catalogue(r).list_items(sort="downloads", page=3).records)


@query(with_views("items", "SELECT 'items' AS kind, (SELECT count(*) FROM items WHERE list_contains(tags, 'clerk 3')) AS total, count(*) AS total_all, CAST(ceil((SELECT count(*) FROM items WHERE list_contains(tags, 'clerk 3')) / 24) AS BIGINT) AS pages, CAST(49 AS BIGINT) AS start, CAST(least(72, (SELECT count(*) FROM items WHERE list_contains(tags, 'clerk 3'))) AS BIGINT) AS until FROM items"))
def listing_numbers(r: Roles) -> DataFrame:
    found = Catalogue(r).list_items(tag="clerk 3", page="3")
    return r.spark.createDataFrame([("items", found.total, found.total_all, found.page.pages, found.page.start, found.page.end)], "kind string, total bigint, total_all bigint, pages bigint, start bigint, until bigint")


@query(with_views("items", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY 1"))
def all_tags(r: Roles) -> DataFrame:
    return Catalogue(r).all_tags()


@query(with_views("items attempts works sites", "SELECT i.item_id, i.title, i.magnet, array_to_string(i.images, ',') AS images, m.work_id, m.title AS work_title, m.site_name FROM items i LEFT JOIN (SELECT a.item_id, w.work_id, w.title, s.name AS site_name FROM attempts a JOIN works w USING (work_id) LEFT JOIN sites s USING (site_id) WHERE a.status = 'matched') m USING (item_id) WHERE i.item_id = 42"))
def get_item(r: Roles) -> DataFrame:
    row = Catalogue(r).get_item("42")
    return row.select("item_id", "title", "magnet", F.array_join("images", ",").alias("images"), F.col("matched_work.work_id").alias("work_id"), F.col("matched_work.title").alias("work_title"), F.col("matched_work.site_name").alias("site_name"))


@query(with_views("items", "SELECT item_id, title, uploader, category, size_bytes FROM items WHERE (title ILIKE '%12%f%' OR uploader ILIKE '%12%f%') AND category = '1-URGENT' ORDER BY size_bytes DESC NULLS LAST, item_id LIMIT 24"))
def items_filtered_page(r: Roles) -> DataFrame:
    rows = r.items.where(selection.item_filter("12%f", "1-URGENT")).select("item_id", "title", "uploader", "category", "size_bytes")
    return selection.page_of(rows, selection.sort_columns(selection.ITEM_ORDERS, "largest", "item_id"))


@query(with_views("items", f"SELECT count(*) AS n FROM items WHERE (title ILIKE '%1%' OR uploader ILIKE '%1%') AND category IN {IN_CATEGORIES}"))
def items_count_filtered(r: Roles) -> DataFrame:
    return catalogue.count_rows(r.items, selection.item_filter("1") & F.col("category").isin(CATEGORIES))


@query(with_views("items", "SELECT category, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, category LIMIT 3"))
def category_facets(r: Roles) -> DataFrame:
    return catalogue.category_facets(r.items, 3)


@query(with_views("tagged", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY 1 ORDER BY n DESC, tag LIMIT 30"))
def tag_facets(r: Roles) -> DataFrame:
    return catalogue.tag_facets(r.tagged, limit=30)


@query(with_views("tagged", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) WHERE trim(tag) <> '' AND contains(lower(tag), 'e') GROUP BY 1"))
def tag_facets_nonblank(r: Roles) -> DataFrame:
    return catalogue.tag_facets(r.tagged, nonblank=True, contains=" E ")


@query(with_views("tagged", "SELECT item_id, title FROM tagged WHERE list_contains(tags, 'red')"))
def tag_filtered_items(r: Roles) -> DataFrame:
    return r.tagged.where(selection.holds_all(F.col("tags"), ["red"]) & selection.item_filter(tag="red")).select("item_id", "title")


LOGO = "coalesce({0}.poster_url, {0}.logo_url) AS image_url"


@query(with_views("sites networks works", f"SELECT s.site_id AS id, s.name, CAST(NULL AS DATE) AS date, {LOGO.format('s')}, n.name AS secondary, count(DISTINCT w.work_id) AS related_count FROM sites s LEFT JOIN networks n USING (network_id) LEFT JOIN works w ON w.site_id = s.site_id GROUP BY ALL ORDER BY related_count DESC, s.name, id LIMIT 24"))
def sites_by_works(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("sites", sort="works").records


@query(with_views("sites networks works", f"SELECT s.site_id AS id, s.name, CAST(NULL AS DATE) AS date, {LOGO.format('s')}, n.name AS secondary, count(DISTINCT w.work_id) AS related_count FROM sites s LEFT JOIN networks n USING (network_id) LEFT JOIN works w ON w.site_id = s.site_id WHERE s.name ILIKE '%a%' GROUP BY ALL ORDER BY secondary NULLS LAST, s.name, id LIMIT 24"))
def sites_by_network(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("sites", "a", sort="network").records


@query(with_views("sites networks", f"SELECT n.network_id AS id, n.name, CAST(NULL AS DATE) AS date, {LOGO.format('n')}, CAST(NULL AS VARCHAR) AS secondary, count(DISTINCT s.site_id) AS related_count FROM networks n LEFT JOIN sites s USING (network_id) GROUP BY ALL"))
def networks_by_sites(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("networks", sort="sites").records


PEOPLE = "SELECT p.person_id AS id, p.name, p.date, coalesce(p.image_url, p.face_url, p.thumbnail_url) AS image_url, p.nationality AS secondary, count(DISTINCT b.work_id) AS related_count FROM people p LEFT JOIN bridge b USING (person_id)"


@query(with_views("people bridge", f"{PEOPLE} WHERE p.name ILIKE '%supplier%' GROUP BY ALL ORDER BY related_count DESC, p.name, id LIMIT 24"))
def people_by_works(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("people", "supplier", sort="works").records


@query(with_views("people bridge", f"{PEOPLE} GROUP BY ALL ORDER BY p.name NULLS LAST, id LIMIT 24"))
def people_default_page(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("people", sort="none of these").records


@query(with_views("people bridge", f"{PEOPLE} GROUP BY ALL ORDER BY p.date NULLS LAST, p.name, id LIMIT 24"))
def people_oldest_page(r: Roles) -> DataFrame:
    return Catalogue(r).list_entities("people", sort="oldest").records


@query(with_views("sites", "SELECT site_id, CASE WHEN site_id % 3 > 0 THEN name END AS name, CAST(row_number() OVER (ORDER BY CASE WHEN site_id % 3 > 0 THEN name END DESC NULLS LAST, site_id) AS INTEGER) AS place FROM sites"))
def entity_sort_variants(r: Roles) -> DataFrame:
    from pyspark.sql import Window

    named = r.sites.select("site_id", F.when(F.col("site_id") % 3 > 0, F.col("name")).alias("name"))
    order = selection.sort_columns(selection.CATALOGUE_ORDERS["sites"], "name_desc", "site_id")
    return named.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # as many rows as sites


@query(
    with_views(
        "items attempts",
        f"""WITH c AS (SELECT count(*) FILTER (WHERE e) AS eligible, count(status) FILTER (WHERE e) AS attempted, count(*) FILTER (WHERE e AND status = 'matched') AS matched,
 count(*) FILTER (WHERE e AND status = 'unmatched') AS unmatched, count(*) FILTER (WHERE e AND status = 'error') AS error, count(*) FILTER (WHERE e AND status = 'no_file') AS no_file
 FROM (SELECT category IN {IN_CATEGORIES} AS e, a.status FROM items LEFT JOIN attempts a USING (item_id)))
 SELECT *, greatest(0, eligible - attempted) AS pending, CASE WHEN attempted > 0 THEN round(matched / attempted * 100, 4) ELSE 0 END AS match_rate FROM c""",
    )
)
def coverage_stats(r: Roles) -> DataFrame:
    return catalogue.coverage(r.items, r.attempts, CATEGORIES)


@query(with_views("items attempts", f"WITH t AS (SELECT status, count(*) AS n FROM attempts GROUP BY 1) SELECT s.status, coalesce(t.n, 0) AS n FROM (VALUES ('matched'), ('unmatched'), ('error'), ('no_file')) s(status) LEFT JOIN t USING (status)"))
def outcome_tally(r: Roles) -> DataFrame:
    return catalogue.outcome_tally(r.attempts, ["matched", "unmatched", "error", "no_file"])


@query(with_views("fetch_log", "SELECT host, count(*) AS requests, count(*) FILTER (WHERE status = 200) AS ok, count(*) FILTER (WHERE status <> 200) AS failed, CASE WHEN count(*) FILTER (WHERE status <> 200) = 0 THEN 'raise the rate' WHEN count(*) FILTER (WHERE status = 200) > 0 THEN 'keep the rate' ELSE 'lower the rate' END AS verdict FROM fetch_log GROUP BY 1"))
def probe_summary(r: Roles) -> DataFrame:
    return catalogue.probe_summary(r.fetch_log)


@query(with_views("items attempts", f"SELECT i.item_id, i.title, i.category, coalesce(a.attempts, 0) AS attempts, i.added_at FROM items i LEFT JOIN attempts a USING (item_id) WHERE i.category IN {IN_CATEGORIES} AND (a.status IS NULL OR (a.status IN ('unmatched', 'error', 'no_file') AND a.next_retry_at IS NOT NULL AND a.next_retry_at <= DATE '{AS_OF}')) ORDER BY i.added_at DESC, i.item_id DESC LIMIT 100"))
def candidates_to_match(r: Roles) -> DataFrame:
    return matching.eligible(r.items, r.attempts, CATEGORIES, F.lit(AS_OF).cast("date"), 100)


IDS = [77, 5, 1200, 9, 311, 42]


@query(with_views("items attempts", f"SELECT i.item_id, a.status, CAST(list_position({IDS}, i.item_id) AS BIGINT) AS place FROM items i LEFT JOIN attempts a USING (item_id) WHERE i.item_id IN (77, 5, 1200, 9, 311, 42) ORDER BY place LIMIT 5"))
def shadow_by_ids(r: Roles) -> DataFrame:
    return matching.shadow(r.items, r.attempts, CATEGORIES, IDS, 5).select("item_id", "status", "place")


@query(with_views("items attempts", f"SELECT i.item_id, a.status, CAST(0 AS BIGINT) AS place FROM items i LEFT JOIN attempts a USING (item_id) WHERE i.category IN {IN_CATEGORIES} AND (a.status IS NULL OR a.status = 'unmatched') ORDER BY i.added_at DESC, i.item_id DESC LIMIT 50"))
def shadow_newest(r: Roles) -> DataFrame:
    return matching.shadow(r.items, r.attempts, CATEGORIES, None, 50).select("item_id", "status", "place")


INDEPENDENT = "status = 'matched' AND work_id IS NOT NULL AND method NOT IN ('resolution_sibling', 'parse_filename_first') AND match_score IS NOT NULL"


@query(with_views("attempts", f"SELECT group_key, item_id, work_id, match_score, CAST(row_number() OVER (PARTITION BY group_key ORDER BY attempted_at DESC, item_id DESC) AS INTEGER) AS place FROM attempts WHERE {INDEPENDENT} QUALIFY place <= 2"))
def latest_reusable(r: Roles) -> DataFrame:
    return matching.reusable(r.attempts)


@query(
    with_views(
        "attempts",
        f"""WITH batch AS (SELECT item_id, group_key, item_id AS place, coalesce(match_score > 0.5, false) AS accepted FROM attempts),
 stored AS (SELECT b.item_id, a.item_id AS source_id FROM batch b JOIN attempts a ON a.group_key = b.group_key AND a.item_id <> b.item_id
  WHERE {INDEPENDENT} QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY a.attempted_at DESC, a.item_id DESC) = 1),
 lead AS (SELECT group_key, arg_min(item_id, place) AS leader, min(place) AS at FROM batch WHERE accepted GROUP BY 1)
 SELECT b.*, coalesce(s.source_id, CASE WHEN b.place > l.at THEN l.leader END) AS source_id FROM batch b LEFT JOIN stored s USING (item_id) LEFT JOIN lead l USING (group_key)""",
    )
)
def reuse_in_batch(r: Roles) -> DataFrame:
    batch = r.attempts.select("item_id", "group_key", F.col("item_id").alias("place"), F.coalesce(F.col("match_score") > 0.5, F.lit(False)).alias("accepted"))
    return matching.with_reuse(batch, r.attempts)


@query(
    with_views(
        "works sites networks people bridge items attempts",
        """SELECT w.work_id, w.title, s.name AS site_name, n.name AS network_name, b.ordinal, p.name AS person, coalesce(p.face_url, p.thumbnail_url, p.image_url) AS image_url FROM works w LEFT JOIN sites s USING (site_id) LEFT JOIN networks n USING (network_id)
 JOIN bridge b USING (work_id) JOIN people p USING (person_id) WHERE w.work_id = 7""",
    )
)
def work_detail_join(r: Roles) -> DataFrame:
    found = Catalogue(r).get_entity("works", "7")
    return found.row.select("work_id", "title", "site_name", "network_name").join(found.parts["people"].select("ordinal", F.col("name").alias("person"), "image_url"))


@query(with_views("items attempts", "SELECT i.item_id, i.title, i.size_bytes FROM items i JOIN attempts a USING (item_id) WHERE a.work_id = 7"))
def work_detail_items(r: Roles) -> DataFrame:
    return Catalogue(r).get_entity("works", 7).parts["items"].select("item_id", "title", "size_bytes")


@query(with_views("items attempts", "WITH own AS (SELECT i.* FROM items i JOIN attempts a USING (item_id) WHERE a.work_id = 7), u AS (SELECT size_bytes, item_id, unnest(list_prepend(image_url, images)) AS url, generate_subscripts(list_prepend(image_url, images), 1) AS k FROM own), f AS (SELECT url, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, item_id, k) AS n FROM u WHERE url <> ''), g AS (SELECT url, min(n) AS n FROM f GROUP BY 1) SELECT string_agg(url, ',' ORDER BY n) AS images FROM g"))
def work_detail_images(r: Roles) -> DataFrame:
    images = Catalogue(r).get_entity("works", 7).parts["images"]
    return images.select(F.when(F.size("images") > 0, F.array_join("images", ",")).alias("images"))  # null without any, as string_agg has it


LINK = f"SELECT w.work_id AS id, w.title AS name, w.date, {WORK_IMAGE} AS image_url FROM works w"
LATEST = "ORDER BY w.date DESC NULLS LAST, w.work_id LIMIT 48"


@query(with_views("works", f"{LINK} WHERE w.site_id = 3 {LATEST}"))
def site_recent_works(r: Roles) -> DataFrame:
    return Catalogue(r).get_entity("sites", 3).parts["works"]


@query(with_views("sites networks", "SELECT s.site_id, s.name, n.name AS network_name, s.poster_url, s.logo_url FROM sites s LEFT JOIN networks n USING (network_id) WHERE s.site_id = 3"))
def site_detail_row(r: Roles) -> DataFrame:
    return Catalogue(r).get_entity("sites", "3").row.select("site_id", "name", "network_name", "poster_url", "logo_url")


@query(with_views("works sites", f"{LINK} WHERE w.site_id IN (SELECT site_id FROM sites WHERE network_id = 2) {LATEST}"))
def network_recent_works(r: Roles) -> DataFrame:
    return Catalogue(r).get_entity("networks", 2).parts["works"]


@query(with_views("works bridge", f"{LINK} WHERE w.work_id IN (SELECT work_id FROM bridge WHERE person_id = 4) {LATEST}"))
def person_works(r: Roles) -> DataFrame:
    return Catalogue(r).get_entity("people", 4).parts["works"]


@query(with_views("people", "SELECT person_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS images FROM (SELECT person_id, [image_url, face_url, thumbnail_url, 'img' || person_id, 'post' || person_id] || CASE WHEN person_id % 4 > 0 THEN ['pf' || person_id, 'pp' || person_id, 'st' || person_id] ELSE [] END AS l FROM people)"))
def people_images(r: Roles) -> DataFrame:
    return r.people.select("person_id", F.array_join(catalogue.person_images(), ",").alias("images"))


@query(with_views("items attempts works sites", "SELECT i.item_id, m.work_id, m.title AS work_title, m.site_name FROM items i LEFT JOIN (SELECT a.item_id, w.work_id, w.title, s.name AS site_name FROM attempts a JOIN works w USING (work_id) LEFT JOIN sites s USING (site_id) WHERE a.status = 'matched') m USING (item_id)"))
def item_details(r: Roles) -> DataFrame:
    rows = catalogue.item_detail(r.items, r.attempts, r.works, r.sites)
    return rows.select("item_id", F.col("matched_work.work_id").alias("work_id"), F.col("matched_work.title").alias("work_title"), F.col("matched_work.site_name").alias("site_name"))


# Each document is a source; benchmark items that hold half of its telling words, or the other way round, are its candidates.
NOISE = ", ".join(f"'{w}'" for w in text.NOISE)
WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({NOISE}) AND NOT regexp_full_match(x, '(e|episode|scene)\\d{{1,4}}')))"
PAIRS = f"""d AS (SELECT doc_id, doc_id % 20 AS day, {WORDS} AS t FROM documents), b AS (SELECT item_id, item_id % 25 AS day, {WORDS} AS t FROM benchmark),
 s AS (SELECT doc_id, item_id, len(list_intersect(d.t, b.t)) / greatest(1, least(len(d.t), len(b.t))) AS ov, doc_id % 3 = item_id % 3 AS site, abs(d.day - b.day) AS delta FROM d, b WHERE ov >= 0.5),
 c AS (SELECT *, 0.35 * ov + CASE WHEN site THEN 0.35 ELSE 0 END + CASE WHEN delta = 0 THEN 0.3 WHEN delta <= 3 THEN 0.2 WHEN delta <= 7 THEN 0.1 ELSE 0 END AS score,
  (delta = 0 AND ov >= 0.5 AND (site OR ov >= 0.8)) OR (delta <= 3 AND ov >= 0.8 AND (site OR ov >= 0.9)) OR (site AND delta <= 7 AND ov >= 0.8) OR (site AND ov >= 0.95 AND delta <= 30) AS accepted FROM s)"""


def _day(key: str, days: int) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col(key) % days).cast("int")).alias("day")


def _tokens(r: Roles, table: str, key: str, days: int) -> DataFrame:
    """Words of each row, behind an exchange that all uses of them share, so that they are made once."""
    words = r.table(table).select(F.col(key), text.content_tokens(F.col("text")).alias("tokens")).repartition(key)
    return words.select("*", _day(key, days))


def _pairs(r: Roles) -> DataFrame:
    """Candidates of at least half the words, with scores."""
    d, b = _tokens(r, "documents", "doc_id", 20), _tokens(r, "benchmark", "item_id", 25)
    pairs = matching.likely_pairs(d.withColumnRenamed("doc_id", "source_id"), b.withColumnRenamed("item_id", "candidate_id"), 0.5)
    pairs = pairs.select(F.col("source_id").alias("doc_id"), F.col("candidate_id").alias("item_id"))
    joined = pairs.join(d, "doc_id").join(b.select("item_id", F.col("day").alias("candidate_day"), F.col("tokens").alias("candidate_tokens")), "item_id")
    return matching.scored(joined.withColumn("site_match", F.col("doc_id") % 3 == F.col("item_id") % 3)).where("overlap >= 0.5")


@query(f"WITH {PAIRS} SELECT doc_id, item_id, round(ov, 4) AS overlap, CAST(delta AS INTEGER) AS delta, round(round(score, 9), 4) AS score, accepted FROM c")
def overlap_scores(r: Roles) -> DataFrame:
    return _pairs(r).select("doc_id", "item_id", F.round("overlap", 4).alias("overlap"), "delta", F.round(F.round("score", 9), 4).alias("score"), "accepted")


def _ranked(r: Roles) -> DataFrame:
    return _pairs(r).withColumns({"candidate_id": F.col("item_id"), "pos": F.col("item_id"), "score": F.round("score", 9)})


RANKED = f"{PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, delta, item_id) AS rn FROM c)"


@query(
    f"""WITH {RANKED},
 a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS nth FROM k WHERE accepted),
 g AS (SELECT doc_id, count(*) AS candidate_count, min(CASE WHEN rn = 1 THEN item_id END) AS best, min(CASE WHEN rn = 1 THEN score END) AS best_score FROM k GROUP BY 1),
 f AS (SELECT doc_id, min(CASE WHEN nth = 1 THEN item_id END) AS one, min(CASE WHEN nth = 1 THEN score END) AS s1, min(CASE WHEN nth = 2 THEN score END) AS s2 FROM a GROUP BY 1)
 SELECT g.doc_id, coalesce(one, best) AS candidate_id, round(round(coalesce(s1, best_score), 9), 4) AS score, one IS NOT NULL AND (s2 IS NULL OR round(s1 - s2, 9) >= 0.08) AS accepted,
 CASE WHEN one IS NULL THEN 'rejected' WHEN s2 IS NULL OR round(s1 - s2, 9) >= 0.08 THEN 'accepted' ELSE 'ambiguous' END AS reason, candidate_count FROM g LEFT JOIN f USING (doc_id)"""
)
def decide_match(r: Roles) -> DataFrame:
    return matching.decisions(_ranked(r), ["doc_id"]).withColumn("score", F.round("score", 4))


@query(f"WITH {RANKED} SELECT doc_id, string_agg(rn || ':' || item_id || CASE WHEN accepted THEN '+' ELSE '-' END, ' ' ORDER BY rn) AS audit FROM k WHERE rn <= 10 GROUP BY 1")
def match_audit(r: Roles) -> DataFrame:
    """The ten best candidates of each source, in order."""
    entry = F.transform("audit", lambda e: F.concat(e["rank"], F.lit(":"), e["id"], F.when(e["accepted"], "+").otherwise("-")))
    return matching.audit(_ranked(r), ["doc_id"]).select("doc_id", F.array_join(entry, " ").alias("audit"))


@query(f"WITH {RANKED}, w AS (SELECT doc_id, max(CASE WHEN accepted THEN rn END) AS chosen, max(rn) AS n FROM k GROUP BY 1), e AS (SELECT k.doc_id, item_id, rn, chosen FROM k JOIN w USING (doc_id)) SELECT doc_id, string_agg(item_id, ' ' ORDER BY rn) AS kept FROM e WHERE rn < 3 OR (rn = 3 AND (chosen IS NULL OR chosen <= 3)) OR (rn = chosen AND chosen > 3) GROUP BY 1")
def audit_kept(r: Roles) -> DataFrame:
    """Three candidates of each source; the last accepted one takes the last place if it lies beyond."""
    ranked = matching.audit(_ranked(r), ["doc_id"], 1 << 30)
    chosen = F.array_max(F.transform("audit", lambda e: F.when(e["accepted"], e["rank"])))
    marked = ranked.withColumn("chosen", chosen).withColumn("audit", F.transform("audit", lambda e: F.struct(e["id"].alias("id"), F.coalesce(e["rank"] == F.col("chosen"), F.lit(False)).alias("selected"))))
    return marked.select("doc_id", F.array_join(F.transform(matching.kept_audit(F.col("audit"), 3), lambda e: e["id"].cast("string")), " ").alias("kept"))


SITE = "('Site ' || (doc_id % 5))"
#: Six stages by item; the search for sites finds the source's own in most cases, one other alone or two others else.
STAGED = f"""{PAIRS}, found AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 4 ELSE doc_id % 5 END AS expected FROM d),
 o AS (SELECT s.doc_id, s.item_id, s.ov, s.delta, s.item_id % 7 AS stage, f.expected, 't' || (s.item_id % 10) AS title, s.item_id % 25 AS day, s.item_id % 5 AS site_id FROM s JOIN found f USING (doc_id) WHERE s.item_id % 7 <= 5 AND (s.item_id % 7 <> 1 OR f.expected IS NOT NULL)),
 u AS (SELECT *, count(*) OVER (PARTITION BY doc_id, stage) AS inspected FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, stage, title, day, site_id ORDER BY item_id) = 1),
 m AS (SELECT *, (stage >= 1 AND coalesce(expected = site_id, false)) OR doc_id % 5 = site_id AS site FROM u),
 v AS (SELECT *, 0.35 * ov + CASE WHEN site THEN 0.35 ELSE 0 END + CASE WHEN delta = 0 THEN 0.3 WHEN delta <= 3 THEN 0.2 WHEN delta <= 7 THEN 0.1 ELSE 0 END AS score,
  (delta = 0 AND ov >= 0.5 AND (site OR ov >= 0.8)) OR (delta <= 3 AND ov >= 0.8 AND (site OR ov >= 0.9)) OR (site AND delta <= 7 AND ov >= 0.8) OR (site AND ov >= 0.95 AND delta <= 30) AS accepted FROM m)"""


@query(
    f"""WITH {STAGED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stage ORDER BY accepted DESC, score DESC, delta, item_id) AS nth FROM v),
 p AS (SELECT doc_id, stage, max(inspected) AS inspected, min(CASE WHEN accepted AND nth = 1 THEN item_id END) AS one, min(CASE WHEN accepted AND nth = 1 THEN score END) AS s1, min(CASE WHEN accepted AND nth = 2 THEN score END) AS s2 FROM n GROUP BY 1, 2),
 q AS (SELECT *, one IS NOT NULL AND (s2 IS NULL OR round(s1 - s2, 9) >= 0.08) AS ok FROM p), x AS (SELECT doc_id, min(CASE WHEN ok THEN stage END) AS at_stage FROM q GROUP BY 1)
 SELECT doc_id AS item_id, max(at_stage) AS stage, max(CASE WHEN stage = at_stage THEN one END) AS candidate_id, round(round(coalesce(max(CASE WHEN stage = at_stage THEN s1 END), 0), 9), 4) AS score,
 CAST(sum(CASE WHEN at_stage IS NULL OR stage <= at_stage THEN inspected ELSE 0 END) AS BIGINT) AS candidate_count, CASE WHEN max(at_stage) IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status FROM q JOIN x USING (doc_id) GROUP BY 1"""
)
def cascade_first_accept(r: Roles) -> DataFrame:
    site = F.col("item_id") % 5
    candidates = _pairs(r).select(
        F.col("doc_id").alias("item_id"), (F.col("item_id") % 7).alias("stage"), F.col("item_id").alias("pos"), F.col("item_id").alias("candidate_id"), F.concat(F.lit("t"), F.col("item_id") % 10).alias("title"), "overlap", F.col("candidate_day").alias("day"), site.alias("site_id"), F.concat(F.lit("SITE-"), site).alias("site_name"), F.lit("").alias("site_short_name")
    )
    sources = r.table("documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("Site "), F.col("doc_id") % 5).alias("label"), _day("doc_id", 20))
    return matching.cascade(sources, candidates, _site_results(sources)).withColumn("score", F.round(F.round("score", 9), 4))


def _site_results(sources: DataFrame) -> DataFrame:
    """What a search for each source's site finds: two others, one other alone, or its own among two."""
    k = F.col("item_id") % 7
    entry = lambda pos, site, name: F.struct(F.lit(pos).alias("pos"), site.cast("bigint").alias("site_id"), F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit("-").alias("short_name"))
    own = entry(1, F.col("item_id") % 5, F.concat(F.lit("site"), F.col("item_id") % 5))
    found = F.when(k == 0, F.array(entry(0, F.lit(1), "other"), entry(1, F.lit(2), "another"))).when(k == 1, F.array(entry(0, F.lit(4), "other"))).otherwise(F.array(entry(0, F.lit(3), "other"), own))
    return sources.select("item_id", F.explode(found).alias("f")).select("item_id", "f.*")


@query("SELECT doc_id AS item_id, CASE WHEN doc_id % 7 = 1 THEN 4 ELSE doc_id % 5 END AS site_id FROM documents WHERE doc_id % 7 > 0")
def site_selection(r: Roles) -> DataFrame:
    sources = r.table("documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("Site "), F.col("doc_id") % 5).alias("label"))
    return matching.select_site(_site_results(sources).join(sources, "item_id"))


@query(f"WITH {PAIRS}, k AS (SELECT doc_id, min(item_id) AS item_id, 't' || (item_id % 10) AS title, item_id % 25 AS day FROM c GROUP BY doc_id, title, day) SELECT doc_id, item_id FROM k")
def distinct_candidates(r: Roles) -> DataFrame:
    titled = _pairs(r).withColumn("title", F.concat(F.lit("t"), F.col("item_id") % 10))
    return matching.distinct_candidates(titled, ["doc_id"], ["title", "candidate_day"], "item_id").select("doc_id", "item_id")


@query(with_views("attempts", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'no_file' WHEN source IS NOT NULL THEN 'matched' WHEN status = 'error' THEN 'error' WHEN status = 'matched' THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN item_id % 5 = 0 THEN 'none' WHEN source IS NOT NULL THEN 'resolution_sibling' WHEN status <> 'matched' THEN 'exhausted' ELSE 'stage_' || attempts END AS method FROM (SELECT *, CASE WHEN method = 'resolution_sibling' THEN item_id - 1 END AS source FROM attempts)"))
def outcome_assembly(r: Roles) -> DataFrame:
    batch = r.attempts.select(
        "item_id",
        F.when(F.col("item_id") % 5 > 0, "a.mp4").alias("filename"),
        F.when(F.col("method") == "resolution_sibling", F.col("item_id") - 1).alias("source_id"),
        F.when(F.col("status") == "error", 500).alias("error_status"),
        F.when(F.col("status") == "matched", F.col("attempts")).alias("stage"),
    )
    return matching.assembled(batch).select("item_id", "status", "method")


@query(with_views("attempts", """SELECT '{"item_id":' || item_id || ',"status":"' || status || '"' || CASE WHEN work_id IS NULL THEN '' ELSE ',"work_id":' || work_id END || '}' AS line FROM attempts"""))
def dry_run_report(r: Roles) -> DataFrame:
    return matching.report_lines(r.attempts.select("status", "item_id", "work_id"))


@query(with_views("attempts", "SELECT * FROM (SELECT group_key, item_id AS root_id, match_score FROM attempts WHERE match_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY attempts, item_id) = 1)"))
def distinct_on_root(r: Roles) -> DataFrame:
    from lodeworks.operators.mutations import latest

    rows = latest(r.attempts.where("match_score IS NOT NULL"), ["group_key"], [F.asc("attempts"), F.asc("item_id")])
    return rows.select("group_key", F.col("item_id").alias("root_id"), "match_score")


@query(with_views("items attempts", "SELECT i.added_at, count(*) AS n FROM items i WHERE EXISTS (SELECT 1 FROM attempts a WHERE a.item_id = i.item_id AND a.method = 'search' AND a.match_score >= 0.5) GROUP BY 1"))
def items_matched_by_day(r: Roles) -> DataFrame:
    good = r.attempts.where("method = 'search' AND match_score >= 0.5").select("item_id")
    return r.items.join(good, "item_id", "left_semi").groupBy("added_at").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS item_id, arg_max(l_partkey, CAST(l_extendedprice * 1000000 AS BIGINT) * 10 - l_linenumber) AS part, max(l_extendedprice) AS price FROM lineitem GROUP BY 1")
def largest_child(r: Roles) -> DataFrame:
    rank = F.struct("l_extendedprice", -F.col("l_linenumber"))
    return r.table("lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.max_by("l_partkey", rank).alias("part"), F.max("l_extendedprice").alias("price"))
