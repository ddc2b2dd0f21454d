"""Text, size, date and page functions over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions import formatters, pages, text
from lodeworks.operators import mapping, outcomes, scan
from lodeworks.plans.registry import query
from lodeworks.sources.roles import Roles, with_views

UNITS = ["KB", "MB", "GiB", "B", "bytes"]


def _sizes(r: Roles) -> DataFrame:
    unit = F.element_at(F.lit(UNITS), (F.col("o_orderkey") % 5 + 1).cast("int"))
    amount = F.format_number((F.col("o_orderkey") * 37).cast("double") / 4, 2)
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), F.concat(amount, F.lit(" "), unit).alias("size_text"), unit.alias("unit"), (F.col("o_orderkey") * 37).alias("quarters"))


SIZE_SQL = f"SELECT item_id, format('{{:,.2f}}', quarters / 4) || ' ' || unit AS size_text, quarters, unit FROM (SELECT o_orderkey AS item_id, o_orderkey * 37 AS quarters, ({UNITS})[o_orderkey % 5 + 1] AS unit FROM orders)"
FACTOR = "CASE unit WHEN 'KB' THEN 1024.0 WHEN 'MB' THEN 1048576.0 WHEN 'GiB' THEN 1073741824.0 ELSE 1.0 END"
START = r"(?i)^\s*([\d.]+)\s*([KMGT]?B)"


@query(f"SELECT item_id, CAST(floor(quarters / 4 * {FACTOR}) AS BIGINT) AS full_size, CASE WHEN regexp_matches(size_text, '{START}') THEN CAST(floor(TRY_CAST(regexp_extract(size_text, '{START}', 1) AS DOUBLE) * pow(1024, strpos('BKMGT', upper(left(regexp_extract(size_text, '{START}', 2), 1))) - 1)) AS BIGINT) END AS plain_size FROM ({SIZE_SQL})")
def size_parse(r: Roles) -> DataFrame:
    """Whole texts with commas, and what starts a text, where a comma ends the number."""
    return _sizes(r).select("item_id", text.size_to_bytes(F.col("size_text")).alias("full_size"), text.parse_size(F.col("size_text")).alias("plain_size"))


@query("SELECT l_orderkey AS item_id, l_linenumber, CASE WHEN v < 1024 THEN CAST(v AS BIGINT) || ' B' WHEN v < 1048576 THEN printf('%.2f KB', v / 1024) WHEN v < 1073741824 THEN printf('%.2f MB', v / 1048576) WHEN v < 1099511627776 THEN printf('%.2f GB', v / 1073741824) ELSE printf('%.2f TB', v / 1099511627776) END AS shown FROM (SELECT *, CAST(pow(2, l_quantity) AS DOUBLE) AS v FROM lineitem)")
def size_format(r: Roles) -> DataFrame:
    return r.table("lineitem").select(F.col("l_orderkey").alias("item_id"), "l_linenumber", formatters.format_size(F.pow(F.lit(2.0), "l_quantity").cast("bigint")).alias("shown"))


@query("SELECT event_id AS item_id, CASE WHEN event_id = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN event_id >= 3600 THEN event_id // 3600 || 'h' END, CASE WHEN event_id % 3600 // 60 > 0 THEN event_id % 3600 // 60 || 'm' END, CASE WHEN event_id % 60 > 0 THEN event_id % 60 || 's' END) END AS shown FROM events")
def duration_format(r: Roles) -> DataFrame:
    return r.fetch_log.select("item_id", formatters.format_duration(F.col("item_id")).alias("shown"))


@query("SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'Pending' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS time, format('{:,}', o_orderkey * 1001) AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE o_orderpriority END AS category FROM orders")
def date_format(r: Roles) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate"))
    category = formatters.shown(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), "Unknown")
    return r.table("orders").select(
        F.col("o_orderkey").alias("item_id"), formatters.format_date(when).alias("day"), formatters.format_time(when).alias("time"), formatters.format_number(F.col("o_orderkey") * 1001).alias("number"), category.alias("category")
    )


NOISE = ", ".join(f"'{w}'" for w in text.NOISE)


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({NOISE}) AND NOT regexp_full_match(x, '(e|episode|scene)\\d{{1,4}}')))) AS telling FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def tokenise_documents(r: Roles) -> DataFrame:
    size = lambda a: F.size(a).cast("bigint")
    counted = text.bound(text.word_tokens(F.col("text")), lambda t: F.struct(size(t).alias("tokens"), size(text.telling(F.array_distinct(t))).alias("telling")))
    return r.table("documents").select("doc_id", counted.alias("c")).select("doc_id", "c.*")


@query(with_views("items", "SELECT p_partkey AS item_id, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), '.') AS key FROM part"))
def scene_key_like(r: Roles) -> DataFrame:
    quality = F.element_at(F.lit([".1080p.x264.mp4", "-720p.mkv", " web-dl.avi", "", ".480p_hevc.ts"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return r.table("part").select(F.col("p_partkey").alias("item_id"), text.group_key(F.concat(F.lit("dir/"), "p_name", quality)).alias("key"))


@query("SELECT p_partkey AS item_id, regexp_replace(string_split(p_name, ' ')[1] || upper(p_name[1]) || 'x2Y', '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS split FROM part")
def camel_split(r: Roles) -> DataFrame:
    name = F.concat(F.get(F.split("p_name", " "), F.lit(0)), F.upper(F.substring("p_name", 1, 1)), F.lit("x2Y"))
    return r.table("part").select(F.col("p_partkey").alias("item_id"), text.split_camel(name).alias("split"))


@query("SELECT o_orderkey AS item_id, CAST(o_orderdate AS DATE) AS day, 'alpha beta' AS rest FROM orders WHERE year(o_orderdate) >= 2000 UNION ALL SELECT o_orderkey, NULL, 'name 99 99 99 alpha beta' FROM orders WHERE year(o_orderdate) < 2000")
def date_in_tokens(r: Roles) -> DataFrame:
    day = F.to_date("o_orderdate")
    late = F.year(day) >= 2000
    short, long = F.date_format(day, "yy.MM.dd"), F.date_format(day, "dd-MM-yyyy")
    name = F.when(late & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("Name."), short, F.lit(".Alpha.Beta"))).when(late, F.concat(F.lit("Name 31 02 2001 "), long, F.lit(" alpha/beta"))).otherwise("name 99.99.99 Alpha beta")
    found = r.table("orders").select(F.col("o_orderkey").alias("item_id"), text.date_and_rest(text.word_tokens(name)).alias("d"))
    return found.select("item_id", "d.day", F.array_join("d.rest", " ").alias("rest"))


@query("SELECT event_id AS item_id, coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END, json_extract_string(props, '$.missing'), event_type) AS filled FROM events")
def json_prop_chain(r: Roles) -> DataFrame:
    own = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k"))
    return r.table("events").select(F.col("event_id").alias("item_id"), F.coalesce(own, F.get_json_object("props", "$.missing"), F.col("event_type")).alias("filled"))


MARKS = ["cf-browser-verification", "_cf_chl_opt", 'id="challenge-form"', "cf-error-details", "Attention Required! | Cloudflare", "Just a moment...", 'class="detailsdiv"', 'class="errordiv"', "captcha challenge-platform"]


@query(f"SELECT page_id, page_id % 9 < 6 AS challenge, page_id % 9 = 6 AS details, page_id % 9 = 7 AS missing FROM pages")
def page_classify(r: Roles) -> DataFrame:
    """Whole pages, each with one mark of an interstitial, a details page, a missing page or none of these behind it."""
    html = F.concat("html", F.element_at(F.lit(MARKS), (F.col("page_id") % 9 + 1).cast("int")))
    has = lambda m: pages.has_any(F.col("html"), m)
    return r.table("pages").withColumn("html", html).select("page_id", has(outcomes.CHALLENGE_MARKERS).alias("challenge"), has(outcomes.DETAIL_MARKERS).alias("details"), has(outcomes.MISSING_MARKERS).alias("missing"))


@query("SELECT coalesce(max(CAST(id AS BIGINT)), 0) AS highest FROM (SELECT unnest(regexp_extract_all(html || '<a href=\"/torrents/details/' || (page_id * 7) || '\">', '/torrents/details/(\\d+)', 1)) AS id FROM pages)")
def page_links_max(r: Roles) -> DataFrame:
    linked = F.concat(F.col("html"), F.lit('<a href="/torrents/details/'), F.col("page_id") * 7, F.lit('">'))
    return scan.listed_ids(r.table("pages").withColumn("html", linked), "html", r"/torrents/details/(\d+)")


def _page_html(without: F.Column | None = None) -> F.Column:
    """A details page around each page's own text, which is its description; ``without``: number of the part that lacks."""

    def row(label, value):
        return F.concat(F.lit(f"<li><span>{label}</span><span>:</span><span>"), value, F.lit("</span></li>"))

    def part(number, value):
        return value if without is None else F.when(without == number, F.lit("")).otherwise(value)

    hash40 = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 40)
    own = F.replace(F.replace(F.col("html"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    votes = F.concat(F.lit("<div class='rating-system'><div class='rating'><a class='like'></a><span>"), F.col("page_id"), F.lit("</span></div><div class='rating'><a class='dislike'></a><span>no</span></div></div>"))
    files = F.concat(F.lit("<div class='filestable'><ul><li><span>Name</span><span>Size</span></li><li><span>a.mkv</span><span>"), F.col("page_id"), F.lit(" MB</span></li><li><span>b.txt</span><span>1 KB</span></li></ul></div>"))
    info = F.concat(F.lit("<font style='font-family: monospace'>Media Info :\nGeneral :\nSize.....: "), F.col("page_id"), F.lit(" MB\nVideo :\nWidth....: 1 920</font>"))
    return F.concat(
        part(1, F.lit("<html><body><div class='detailsdiv'>")), part(3, F.concat(F.lit("<h1> Title "), F.col("page_id"), F.lit(" </h1>"))), part(2, F.lit("<div class='detailsdescr'>")), F.lit("<ul>"),
        row("Category", F.lit("<a>Films</a>")), row("Size", F.concat(F.col("page_id"), F.lit(".5 KB"))), part(5, row("Added Date", F.lit("3 Feb 2024 04:05:06"))),
        row("Peers", F.concat(F.lit("<font class='see'>"), F.col("page_id"), F.lit("</font><font class='lee'>x</font>"))), row("Collection", F.lit("<a>one</a> <a>two</a>")),
        part(4, F.concat(F.lit("<li class='downloadboxlist'><a href='magnet:?xt=urn:btih:"), F.upper(hash40), F.lit("'>m</a></li>"))), F.lit("</ul></div>"), votes, files,
        F.lit("<div class='description'>"), info, F.lit("<img src='http://x/1s/"), F.col("page_id"), F.lit(".jpg'>"), F.lit("<a href='y'><img src='z'></a>"), own, F.lit("<br><br><br><br>end</div></div>"),
    )


@query("SELECT page_id AS item_id, CAST(NULL AS VARCHAR) AS error, 'Title ' || page_id AS title, page_id * 1024 + 512 AS size_bytes, substr(sha256(CAST(page_id AS VARCHAR)), 1, 40) AS info_hash, page_id AS seeders, 0 AS leechers, 'one,two' AS tags, trim(regexp_replace(html || chr(10) || chr(10) || chr(10) || chr(10) || 'end', '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS description, '2024-02-03 04:05:06' AS added FROM pages")
def page_parse(r: Roles) -> DataFrame:
    rows = pages.parse_pages(r.table("pages").withColumn("html", _page_html()), "page_id", "html")
    joined = F.when(F.col("tags").isNotNull(), F.array_join("tags", ","))
    return rows.select("item_id", "error", "title", "size_bytes", "info_hash", "seeders", "leechers", joined.alias("tags"), F.col("description_text").alias("description"), F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added"))


@query("""SELECT page_id AS item_id, page_id AS likes, 0 AS dislikes, 'a.mkv=' || page_id || ' MB,b.txt=1 KB' AS files, 'http://x/1/' || page_id || '.jpg,z' AS images, '{"General": {"Size": "' || page_id || ' MB"}, "Video": {"Width": "1 920"}}' AS media_info FROM pages""")
def page_parts(r: Roles) -> DataFrame:
    """Votes, files, images and media lines of the same pages."""
    rows = pages.parse_pages(r.table("pages").withColumn("html", _page_html()), "page_id", "html")
    files = F.array_join(F.transform("files", lambda f: F.concat(f["filename"], F.lit("="), f["size_text"])), ",")
    return rows.select("item_id", "likes", "dislikes", files.alias("files"), F.array_join("images", ",").alias("images"), "media_info")


@query("SELECT page_id AS item_id, (['missing details', 'missing description list', 'missing title', 'missing magnet link', 'missing or bad added date', NULL])[page_id % 6 + 1] AS error FROM pages")
def page_errors(r: Roles) -> DataFrame:
    """Details pages that lack one part each, and whole ones."""
    html = _page_html((F.col("page_id") % 6 + 1).cast("int"))
    return pages.parse_pages(r.table("pages").withColumn("html", html), "page_id", "html").select("item_id", "error")


@query("SELECT page_id AS item_id, 'missing details' AS error FROM pages")
def page_parse_other(r: Roles) -> DataFrame:
    """Pages as they are: none is a details page."""
    return pages.parse_pages(r.table("pages"), "page_id", "html").select("item_id", "error")


def _records(r: Roles) -> DataFrame:
    """Nested work records of works, sites and networks."""
    site = F.struct(F.col("site_id").alias("id"), F.col("site_name").alias("name"), F.col("network_id"), F.struct(F.col("network_id").alias("id"), F.col("network_name").alias("name")).alias("parent"))
    person = F.struct((F.col("work_id") % 50).alias("id"), F.lit("x").alias("name"), F.struct((F.col("work_id") % 7).alias("id"), F.lit("Profile").alias("name")).alias("parent"))
    joined = r.works.join(r.sites.withColumnRenamed("name", "site_name"), "site_id").join(r.networks.withColumnRenamed("name", "network_name"), "network_id")
    raw = F.struct(F.col("work_id").cast("string").alias("id"), F.col("work_id").alias("_id"), F.col("title"), F.lit("2020-02-03T00:00").alias("date"), site.alias("site"), F.array(person).alias("performers"), F.array(F.struct(F.col("type").alias("name"))).alias("tags"))
    return joined.select(F.to_json(raw).alias("raw_json"))


@query(with_views("works sites networks", "SELECT CAST(work_id AS VARCHAR) AS work_id, w.title, DATE '2020-02-03' AS date, w.site_id, w.type AS tags, s.name AS site, n.name AS network, work_id % 7 AS person_id, 0 AS ordinal FROM works w JOIN sites s USING (site_id) JOIN networks n USING (network_id)"))
def bundle_map(r: Roles) -> DataFrame:
    found = mapping.bundle(_records(r))
    works = found["works"].select("work_id", "title", "date", "site_id", F.array_join("tags", ",").alias("tags"))
    sites = found["sites"].select("site_id", F.col("name").alias("site"), "network_id").join(found["networks"].select("network_id", F.col("name").alias("network")), "network_id").drop("network_id")
    return works.join(sites, "site_id").join(found["bridge"], "work_id")


@query("SELECT item_id AS query_id, CAST(pos AS INTEGER) AS pos, w AS name, CAST(CASE WHEN item_id % 3 = 0 THEN len(t) ELSE 3 END AS BIGINT) AS total, item_id % 5 = 0 AS error FROM (SELECT item_id, t, unnest(CASE WHEN item_id % 5 > 0 THEN t ELSE [NULL] END) AS w, unnest(CASE WHEN item_id % 5 > 0 THEN range(len(t)) ELSE [NULL] END) AS pos FROM (SELECT item_id, string_split(text, ' ') AS t FROM benchmark)) WHERE item_id % 5 > 0 UNION ALL SELECT item_id, NULL, NULL, NULL, true FROM benchmark WHERE item_id % 5 = 0")
def candidate_lists(r: Roles) -> DataFrame:
    """A list of all words of each item; some without a total, some without a list."""
    data = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("name")))
    good = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(data.alias("data")))).otherwise(F.to_json(F.struct(data.alias("data"), F.struct(F.lit(3).alias("total")).alias("meta"))))
    raw = F.when(F.col("item_id") % 5 == 0, F.lit('{"data": null}')).otherwise(good)
    rows = mapping.candidate_rows(r.table("benchmark").select(F.col("item_id").alias("query_id"), raw.alias("raw_json")))
    return rows.select("query_id", "pos", F.get_json_object("candidate", "$.name").alias("name"), "total", "error")


@query("SELECT o_orderkey AS item_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN 3600 END AS DOUBLE) AS seconds FROM orders")
def retry_after_parse(r: Roles) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.lit("Mon, 01 Jan 2024 01:00:00 GMT")).otherwise(F.lit("nan"))
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), text.retry_after(value, as_of).alias("seconds"))


@query("SELECT o_orderkey AS item_id, array_to_string(CASE o_orderkey % 5 WHEN 0 THEN [o_orderstatus, CAST(o_orderkey AS VARCHAR)] ELSE [] END, ',') AS entries FROM orders")
def json_list_or_empty(r: Roles) -> DataFrame:
    """Lists, null, bad JSON, an object and a text."""
    k = F.col("o_orderkey") % 5
    good = F.concat(F.lit('["'), F.col("o_orderstatus"), F.lit('", "'), F.col("o_orderkey"), F.lit('"]'))
    raw = F.when(k == 0, good).when(k == 2, "[1, 2").when(k == 3, '{"a": []}').when(k == 4, '"x"')
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), F.array_join(text.json_list(raw), ",").alias("entries"))


@query("""SELECT o_orderkey AS item_id, '[{"source_item_id":' || o_custkey || '}]' AS json, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS source FROM orders""")
def source_lists(r: Roles) -> DataFrame:
    """The JSON list that names a source, and the source of lists that name one, some of them badly."""
    made = text.source_list(F.col("o_custkey"))
    bad = F.when(F.col("o_orderkey") % 3 == 0, F.replace(made, F.lit("}"), F.lit('.5}'))).otherwise(made)
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), made.alias("json"), text.source_of(bad).alias("source"))


@query("SELECT event_id AS item_id, c_name AS name FROM events JOIN customer ON CAST(json_extract_string(props, '$.k') AS BIGINT) = c_custkey")
def join_on_json_key(r: Roles) -> DataFrame:
    """Events with the customer that their JSON names."""
    key = r.table("events").select(F.col("event_id").alias("item_id"), F.get_json_object("props", "$.k").try_cast("bigint").alias("c_custkey"))
    return key.join(r.table("customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey").select("item_id", "name")


FILES = """SELECT l_orderkey AS item_id, CASE WHEN l_linenumber % 3 = 0 THEN 'f' || l_linenumber || '.MKV' WHEN l_linenumber % 5 = 0 THEN '' ELSE 'f' || l_linenumber || '.txt' END AS filename,
 CASE WHEN l_linenumber % 4 = 0 THEN 'no size' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' kb' END AS size_text, CASE WHEN l_linenumber % 4 = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) * 1024 END AS size, l_linenumber FROM lineitem"""


@query(f"SELECT item_id, filename, CASE WHEN size >= 0 THEN size END AS size_bytes FROM ({FILES}) WHERE filename <> '' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY filename LIKE '%.MKV' DESC, size DESC, l_linenumber) = 1")
def largest_file(r: Roles) -> DataFrame:
    """The file that names each item: a video first, then the larger, then the earlier one."""
    k = F.col("l_linenumber")
    name = F.when(k % 3 == 0, F.concat(F.lit("f"), k, F.lit(".MKV"))).when(k % 5 == 0, "").otherwise(F.concat(F.lit("f"), k, F.lit(".txt")))
    size = F.when(k % 4 == 0, "no size").otherwise(F.concat(F.col("l_quantity").cast("bigint"), F.lit(" kb")))
    each = r.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.struct(k.alias("k"), name.alias("filename"), size.alias("size_text")).alias("f"))
    files = F.transform(F.sort_array(F.collect_list("f")), lambda f: F.struct(f["filename"].alias("filename"), f["size_text"].alias("size_text")))
    best = each.groupBy("item_id").agg(text.largest_file(files).alias("best"))
    return best.where("best IS NOT NULL").select("item_id", "best.filename", "best.size_bytes")


@query("SELECT p_partkey AS item_id, replace(lower(p_name), ' ', '.') || (['', '', '.web.dl', '', ''])[p_partkey % 5 + 1] AS stored_key FROM part")
def stored_scene_key(r: Roles) -> DataFrame:
    """The narrower key of the back-fill, which knows fewer endings."""
    quality = F.element_at(F.lit([".1080p.x264.mp4", "-720p.mkv", " web-dl.avi", "", ".480p_hevc.ts"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return r.table("part").select(F.col("p_partkey").alias("item_id"), text.stored_group_key(F.concat("p_name", quality)).alias("stored_key"))


@query("""SELECT o_orderkey AS item_id, 'Site' || (o_custkey % 9) AS site_label, CAST(o_orderdate AS DATE) AS day, 'alpha beta' AS content, 'alpha,beta' AS tokens, 'site' || (o_custkey % 9) || '.' || strftime(o_orderdate, '%y.%m.%d') || '.alpha.beta.xxx' AS group_key, 'alpha beta|gamma delta' AS queries FROM orders WHERE year(o_orderdate) >= 2000
 UNION ALL SELECT o_orderkey, 'Site' || (o_custkey % 9), NULL, 'site' || (o_custkey % 9) || ' alpha beta', 'site' || (o_custkey % 9) || ',alpha,beta', 'site' || (o_custkey % 9) || '.alpha.beta', 'site' || (o_custkey % 9) || ' alpha beta|gamma delta' FROM orders WHERE year(o_orderdate) < 2000""")
def match_sources(r: Roles) -> DataFrame:
    """What a file name and a title say of an item: site, day, words, key and searches."""
    day = F.to_date("o_orderdate")
    site = F.concat(F.lit("Site"), F.col("o_custkey") % 9)
    name = F.when(F.year(day) >= 2000, F.concat(site, F.lit("."), F.date_format(day, "yy.MM.dd"), F.lit(".Alpha.Beta.XXX.1080p.mp4"))).otherwise(F.concat(site, F.lit(".alphaBeta.mp4")))
    plain = F.when(F.year(day) >= 2000, name).otherwise(F.concat(site, F.lit(".Alpha.Beta.mp4")))
    made = text.match_source(plain, F.concat(site, F.lit(" Gamma the Delta")), F.col("o_orderpriority"))
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), made.alias("m")).select("item_id", "m.site_label", "m.day", "m.content", F.array_join("m.tokens", ",").alias("tokens"), "m.group_key", F.array_join("m.queries", "|").alias("queries"))


@query("SELECT o_orderkey AS item_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS h FROM orders)")
def uuids(r: Roles) -> DataFrame:
    h = F.md5(F.col("o_orderkey").cast("string"))
    dashed = F.regexp_replace(F.upper(h), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "{$1-$2-$3-$4-$5}")
    given = F.element_at(F.array(h, dashed, F.concat(F.lit("urn:uuid:"), h), F.concat(h, F.lit("0"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), text.uuid(given).alias("uuid"))


@query("SELECT p_partkey AS item_id, (['p' || p_partkey, 'm' || p_partkey, NULL, NULL])[p_partkey % 4 + 1] AS url FROM part")
def assets(r: Roles) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"poster": "p'), k, F.lit('"}'))).when(k % 4 == 1, F.concat(F.lit('{"poster": {"full": "", "medium": "m'), k, F.lit('"}}'))).when(k % 4 == 2, '{"poster": ""}').otherwise("{}")
    return r.table("part").select(k.alias("item_id"), text.asset(raw, "poster").alias("url"))


@query("SELECT c_custkey AS item_id, c_name AS name FROM customer")
def unscrambled_names(r: Roles) -> DataFrame:
    """Names that were scrambled by a key byte, read again."""
    key = (F.col("c_custkey") % 100 + 1).cast("int")
    letters = F.transform(F.split("c_name", ""), lambda c: F.lpad(F.lower(F.hex(F.ascii(c).bitwiseXOR(key))), 2, "0"))
    scrambled = F.concat(F.lpad(F.lower(F.hex(key.cast("bigint"))), 2, "0"), F.array_join(letters, ""))
    return r.table("customer").select(F.col("c_custkey").alias("item_id"), text.xor_text(scrambled).alias("name"))


@query("SELECT o_orderkey AS item_id, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def lenient_dates(r: Roles) -> DataFrame:
    """Dates with and without dashes, as a week and a day in both forms, and two that are none."""
    day = F.to_date("o_orderdate")
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    year, weekday = F.extract(F.lit("YEAROFWEEK"), day).cast("string"), (F.weekday(day) + 1).cast("string")
    forms = [F.date_format(day, "yyyy-MM-dd'T'HH:mm"), F.date_format(day, "yyyyMMdd"), F.concat(year, F.lit("-W"), week, F.lit("-"), weekday), F.concat(year, F.lit("W"), week, weekday), F.lit("2020-02-30"), F.concat(year, F.lit("-W60-1"))]
    return r.table("orders").select(F.col("o_orderkey").alias("item_id"), text.iso_date(F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("day"))


@query("SELECT s_suppkey AS item_id, lower(replace(s_name, '#', '')) AS plain, CAST(NULL AS VARCHAR) IS NULL AS blank FROM supplier")
def plain_names(r: Roles) -> DataFrame:
    return r.table("supplier").select(F.col("s_suppkey").alias("item_id"), text.plain_name(F.col("s_name")).alias("plain"), (text.plain_name(F.lit(None).cast("string")) == "").alias("blank"))
