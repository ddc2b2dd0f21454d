"""Outcomes, scheduling, ledger changes and lineage over the role views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import pages
from lodeworks.operators import lineage, mapping, mutations, outcomes, scan, selection
from lodeworks.plans.registry import query
from lodeworks.sources.roles import Roles, with_views

KIND = "CASE WHEN status IS NULL THEN 'connection_error' WHEN status = 404 THEN 'not_found' WHEN status IN (301, 302, 303, 307, 308) THEN 'redirect' WHEN status IN (403, 429) THEN 'blocked' WHEN status >= 500 THEN 'server_error' WHEN status <> 200 THEN 'unexpected_status' ELSE 'ok' END"


def _kinds(r: Roles) -> DataFrame:
    return r.fetch_log.withColumn("kind", outcomes.outcome_kind(F.col("status")))


@query(with_views("fetch_log", f"SELECT item_id, {KIND} AS kind, CASE WHEN item_id % 2 = 0 THEN status || '->/x' ELSE CAST(status AS VARCHAR) END AS http FROM fetch_log"))
def classify_outcomes(r: Roles) -> DataFrame:
    place = F.when(F.col("item_id") % 2 == 0, F.lit("/x"))
    return _kinds(r).select("item_id", "kind", outcomes.http_text(F.col("status"), place).alias("http"))


LEDGER = ["frontier_missing", "internal_gap", "gone", "transient_error", "parse_error"]


@query(f"SELECT event_id AS item_id, CAST(CASE ({LEDGER})[event_id % 5 + 1] WHEN 'frontier_missing' THEN 300 WHEN 'internal_gap' THEN 2592000 WHEN 'transient_error' THEN 900 WHEN 'parse_error' THEN 900 END AS INTEGER) AS wait FROM events")
def ledger_retry(r: Roles) -> DataFrame:
    status = F.element_at(F.lit(LEDGER), (F.col("item_id") % 5 + 1).cast("int"))
    return r.fetch_log.select("item_id", outcomes.ledger_retry_seconds(status).alias("wait"))


@query("SELECT event_id AS item_id, CAST(CASE WHEN event_id * 500 < 604800 THEN 21600 WHEN event_id * 500 < 2592000 THEN 86400 ELSE 604800 END AS INTEGER) AS wait FROM events")
def refresh_cadence(r: Roles) -> DataFrame:
    return r.fetch_log.select("item_id", outcomes.refresh_seconds(F.col("item_id") * 500).alias("wait"))


@query(with_views("attempts fetch_log", "SELECT item_id, CAST(CASE WHEN attempts < 2 THEN 21600 WHEN attempts < 4 THEN 86400 WHEN attempts < 7 THEN 604800 ELSE 2592000 END AS INTEGER) AS unmatched_wait, CAST(CASE WHEN f.status = 429 THEN 900 ELSE 3600 END AS INTEGER) AS error_wait FROM attempts JOIN fetch_log f USING (item_id)"))
def backoff(r: Roles) -> DataFrame:
    joined = r.attempts.select("item_id", "attempts").join(r.fetch_log.select("item_id", "status"), "item_id")
    return joined.select("item_id", outcomes.unmatched_seconds(F.col("attempts")).alias("unmatched_wait"), outcomes.error_seconds(F.col("status")).alias("error_wait"))


COOL = f"""k AS (SELECT *, {KIND} AS kind FROM fetch_log), r AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY "at", item_id) AS run FROM k),
 n AS (SELECT *, sum(CASE WHEN kind = 'blocked' THEN 1 ELSE 0 END) OVER (PARTITION BY host, run ORDER BY "at", item_id) AS nth FROM r),
 cool AS (SELECT *, CAST(CASE WHEN kind = 'blocked' THEN coalesce(CASE WHEN retry_after > 0 THEN least(900, retry_after) END, least(900, 60 * pow(2, least(nth - 1, 20)))) WHEN kind = 'server_error' THEN 5 ELSE 0 END AS BIGINT) AS cooldown FROM n)"""


@query(with_views("fetch_log", f"WITH {COOL} SELECT item_id, host, kind, cooldown FROM cool"))
def cooldown_islands(r: Roles) -> DataFrame:
    return outcomes.cooldowns(_kinds(r), ["at", "item_id"]).select("item_id", "host", "kind", "cooldown")


@query(with_views("fetch_log", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY "at", item_id) - 1 AS n FROM fetch_log) SELECT item_id, host, CAST(max("at" - n * 120) OVER (PARTITION BY host ORDER BY n) + n * 120 AS DOUBLE) AS start FROM n"""))
def pacing_schedule(r: Roles) -> DataFrame:
    return outcomes.pacing(r.fetch_log, ["at", "item_id"], 120).select("item_id", "host", "start")


@query(
    with_views(
        "fetch_log",
        f"""WITH {COOL}, rest AS (SELECT host % 3 AS host, "at" AS b, "at" + cooldown AS e FROM cool WHERE cooldown > 0),
 o AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR max(e) OVER w < b THEN 1 ELSE 0 END AS fresh FROM rest WINDOW w AS (PARTITION BY host ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 p AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS piece FROM o), m AS (SELECT host, piece, min(b) AS b, max(e) AS e FROM p GROUP BY 1, 2),
 ev AS (SELECT "at", sum(c) AS c FROM (SELECT b AS "at", 1 AS c FROM m UNION ALL SELECT e, -1 FROM m) GROUP BY 1),
 s AS (SELECT *, sum(c) OVER (ORDER BY "at") AS n FROM ev)
 SELECT "at" FROM s WHERE n >= 2 AND n - c < 2""",
    )
)
def all_cooling_episodes(r: Roles) -> DataFrame:
    cool = outcomes.cooldowns(_kinds(r), ["at", "item_id"]).where("cooldown > 0")
    resting = cool.select((F.col("host") % 3).alias("host"), F.col("at").alias("begin"), (F.col("at") + F.col("cooldown")).alias("end"))
    return outcomes.all_resting(resting, 2)


@query(with_views("fetch_log", """SELECT item_id, host FROM fetch_log WHERE retry_after IS NOT NULL AND "at" + retry_after <= (SELECT max("at") FROM fetch_log) - 86400 ORDER BY "at" + retry_after, item_id LIMIT 200"""))
def due_queue(r: Roles) -> DataFrame:
    as_of = r.fetch_log.agg(F.max("at") - 86400).scalar()
    return scan.due_queue(r.fetch_log.withColumn("next_retry_at", F.col("at") + F.col("retry_after")), "next_retry_at", as_of, 200, "item_id").select("item_id", "host")


@query("SELECT r.i AS item_id FROM range(0, 1000) r(i) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.i) AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = r.i AND event_type = 'error')")
def id_gap_coverage(r: Roles) -> DataFrame:
    known = r.table("lineitem").select(F.col("l_orderkey").alias("item_id"))
    return scan.unresolved(r.spark, 0, 1000, known, r.table("events").where("event_type = 'error'").select(F.col("event_id").alias("item_id")))


@query("SELECT id + 1 AS gap_start, nxt - 1 AS gap_end FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem)) WHERE nxt > id + 1")
def id_gap_ranges(r: Roles) -> DataFrame:
    return scan.gaps(r.table("lineitem").select(F.col("l_orderkey").alias("item_id")))


@query(
    with_views(
        "items",
        """SELECT dated, coalesce(all_old, false) AS all_old, pending, dated > 0 AND coalesce(all_old, false) AND pending = 0 AS confirmed FROM
 (SELECT count(added_at) AS dated, bool_and(added_at < DATE '2002-01-01') FILTER (WHERE added_at IS NOT NULL) AS all_old FROM items WHERE item_id BETWEEN 100 AND 199),
 (SELECT count(*) AS pending FROM events WHERE event_id BETWEEN 100 AND 199 AND event_type NOT IN ('view', 'click'))""",
    )
)
def confirm_window(r: Roles) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "gone").when(F.col("event_type") == "click", "internal_gap").otherwise("transient_error")
    ledger = r.table("events").select(F.col("event_id").alias("item_id"), status.alias("status"))
    return scan.window_is_old(r.items, ledger, 100, 100, F.lit("2002-01-01").cast("date"))


@query(
    """WITH k AS (SELECT user_id AS item_id, event_id, event_type, ts < TIMESTAMP '2024-01-15' AS early FROM events), old AS (SELECT item_id, arg_max(event_type, event_id) AS status, count(*) AS attempts FROM k WHERE early GROUP BY 1),
 new AS (SELECT item_id, arg_max(event_type, event_id) AS status, count(*) AS n FROM k WHERE NOT early GROUP BY 1)
 SELECT item_id, coalesce(new.status, old.status) AS status, CAST(coalesce(attempts, 0) + coalesce(n, 0) AS BIGINT) AS attempts FROM old FULL JOIN new USING (item_id)"""
)
def upsert_latest(r: Roles) -> DataFrame:
    log = r.table("events").select(F.col("user_id").alias("item_id"), "event_id", F.col("event_type").alias("status"), "ts")
    none = log.limit(0).select("item_id", "status", F.lit(0).cast("bigint").alias("attempts"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    ledger = mutations.apply_ledger(none, log.where(early), ["event_id"])
    return mutations.apply_ledger(ledger, log.where(~early), ["event_id"])


@query(
    with_views(
        "items",
        """WITH old AS (SELECT item_id, title, added_at AS first_seen_at, added_at AS scraped_at FROM items WHERE added_at < DATE '1999-01-01'), new AS (SELECT item_id, title || '!' AS title FROM items WHERE added_at >= DATE '1997-01-01')
 SELECT item_id, coalesce(new.title, old.title) AS title, coalesce(first_seen_at, DATE '2024-01-01') AS first_seen_at, CASE WHEN new.title IS NOT NULL THEN DATE '2024-01-01' ELSE scraped_at END AS scraped_at FROM old FULL JOIN new USING (item_id)""",
    )
)
def upsert_items(r: Roles) -> DataFrame:
    stored = r.items.where("added_at < DATE '1999-01-01'").select("item_id", "title", F.col("added_at").alias("first_seen_at"), F.col("added_at").alias("scraped_at"))
    parsed = r.items.where("added_at >= DATE '1997-01-01'").select("item_id", F.concat("title", F.lit("!")).alias("title"))
    return mutations.apply_items(stored, stored, parsed, F.lit("2024-01-01").cast("date"))[0]


@query(with_views("items", "SELECT item_id FROM items WHERE added_at < DATE '1999-01-01' AND NOT added_at >= DATE '1997-01-01'"))
def ledger_after_success(r: Roles) -> DataFrame:
    ledger = r.items.where("added_at < DATE '1999-01-01'").select("item_id")
    return mutations.apply_items(r.items.select("item_id").withColumn("first_seen_at", F.lit(None).cast("date")).withColumn("scraped_at", F.lit(None).cast("date")), ledger, r.items.where("added_at >= DATE '1997-01-01'").select("item_id"), F.lit("2024-01-01").cast("date"))[1]


@query(with_views("items", "SELECT item_id, added_at, CASE WHEN added_at <= DATE '1996-12-31' THEN DATE '2024-01-01' ELSE added_at END AS next_refresh_at FROM items"))
def refresh_bumped(r: Roles) -> DataFrame:
    items = r.items.select("item_id", "added_at", F.col("added_at").alias("next_refresh_at"))
    due = items.where(selection.due(F.col("next_refresh_at"), F.lit("1996-12-31").cast("date")))
    return mutations.bump(items, due.unionAll(due), F.lit("2024-01-01").cast("date"))


@query(with_views("items", "SELECT item_id, title FROM items"))
def insert_missing(r: Roles) -> DataFrame:
    rows = r.items.select("item_id", "title")
    changed = rows.where("title LIKE '%F'").unionAll(rows.where("title NOT LIKE '%F'").withColumn("title", F.col("title")))
    return mutations.insert_missing(rows.where("title LIKE '%F'"), changed, "item_id")


@query("SELECT event_id AS item_id, CASE WHEN event_type = 'click' AND event_id < (SELECT max(o_orderkey) FROM orders) // 2 THEN 'internal_gap' WHEN event_type = 'click' THEN 'frontier_missing' ELSE event_type END AS status FROM events")
def reclassify_gaps(r: Roles) -> DataFrame:
    highest = F.floor(r.table("orders").agg(F.max("o_orderkey")).scalar() / 2)
    status = F.when(F.col("event_type") == "click", "frontier_missing").otherwise(F.col("event_type"))
    return mutations.reclassify(r.table("events").select(F.col("event_id").alias("item_id"), status.alias("status")), highest)


@query(with_views("bridge works", "WITH new AS (SELECT work_id, person_id + 1000000 AS person_id, ordinal FROM bridge JOIN works USING (work_id) WHERE type = 'BUILDING' AND ordinal = 1) SELECT * FROM bridge WHERE work_id NOT IN (SELECT work_id FROM new) UNION ALL SELECT * FROM new"))
def replace_children(r: Roles) -> DataFrame:
    new = r.bridge.join(r.works.where("type = 'BUILDING'").select("work_id"), "work_id").where("ordinal = 1").withColumn("person_id", F.col("person_id") + 1000000)
    return mutations.replace_children(r.bridge, new, "work_id")


@query(with_views("works sites", "SELECT work_id, CASE WHEN s.name < 'K' THEN w.site_id END AS site_id FROM works w JOIN sites s USING (site_id)"))
def foreign_keys_nulled(r: Roles) -> DataFrame:
    return mutations.null_missing(r.works, "site_id", r.sites.where("name < 'K'"), "site_id").select("work_id", "site_id")


TURNS = "t AS (SELECT conv_id * 1000 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent, conv_id, turn FROM conversations)"


def _turns(r: Roles) -> DataFrame:
    node = F.col("conv_id") * 1000 + F.col("turn")
    return r.table("conversations").select(node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent"), "turn", "conv_id")


@query(f"WITH RECURSIVE {TURNS}, c AS (SELECT node FROM t WHERE turn = 2 UNION SELECT t.node FROM t JOIN c ON t.parent = c.node) SELECT node FROM c")
def lineage_closure(r: Roles) -> DataFrame:
    turns = _turns(r)
    return lineage.closure(turns.where("turn = 2").select("node"), turns.where("parent IS NOT NULL").select("node", "parent"))


@query(
    f"""WITH RECURSIVE {TURNS}, a AS (SELECT t.node, p.node AS parent FROM t LEFT JOIN t p ON t.parent = p.node), w AS (SELECT node, node AS root, 0 AS depth FROM a WHERE parent IS NULL AND node IN (SELECT parent FROM a)
 UNION ALL SELECT a.node, w.root, w.depth + 1 FROM a JOIN w ON a.parent = w.node) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM w"""
)
def lineage_root_score(r: Roles) -> DataFrame:
    turns = _turns(r)
    edges = turns.where("parent IS NOT NULL").select("node", "parent")
    return lineage.roots(edges.join(turns.select(F.col("node").alias("parent")), "parent", "left_semi"))


#: Attempts whose matches are taken over along each conversation: from the turn before, or twice before after a tool's turn.
TAKEN = """t AS (SELECT conv_id * 1000 + turn AS item_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS source_id, CAST(conv_id AS VARCHAR) AS work_id, CASE WHEN turn % 6 = 5 THEN NULL ELSE 'k' || (turn // 6) END AS group_key,
 CASE WHEN turn = 0 THEN 1 + length(text) % 10 END AS match_score, CASE WHEN turn > 0 THEN 'resolution_sibling' WHEN length(text) % 4 = 0 THEN 'legacy_sibling' ELSE 'search' END AS method FROM conversations),
 e AS (SELECT c.item_id AS node, p.item_id AS parent FROM t c JOIN t p ON c.source_id = p.item_id AND c.work_id = p.work_id AND c.group_key IS NOT DISTINCT FROM p.group_key),
 gone AS (SELECT item_id AS node FROM t WHERE method = 'legacy_sibling' UNION SELECT e.node FROM e JOIN gone ON e.parent = gone.node), kept AS (SELECT * FROM t WHERE item_id NOT IN (SELECT node FROM gone))"""


def _taken(r: Roles) -> DataFrame:
    turn, size = F.col("turn"), F.length("text")
    item = F.col("conv_id") * 1000 + turn
    source = mutations.source_column(F.when(turn > 0, item - 1))
    return r.table("conversations").select(
        item.alias("item_id"),
        source.alias("source_id"),
        F.col("conv_id").cast("string").alias("work_id"),
        F.when(turn % 6 != 5, F.concat(F.lit("k"), F.floor(turn / 6))).alias("group_key"),
        F.when(turn == 0, 1 + size % 10).cast("double").alias("match_score"),
        F.when(turn > 0, "resolution_sibling").when(size % 4 == 0, "legacy_sibling").otherwise("search").alias("method"),
    )


@query(f"WITH RECURSIVE {TAKEN} SELECT node, parent FROM e")
def sibling_edges(r: Roles) -> DataFrame:
    """Edges by the source that each row's JSON names."""
    return lineage.sibling_edges(_taken(r))


@query(f"WITH RECURSIVE {TAKEN} SELECT item_id FROM kept")
def without_legacy(r: Roles) -> DataFrame:
    return lineage.without_legacy(_taken(r), F.col("method") == "legacy_sibling").select("item_id")


@query(
    f"""WITH RECURSIVE {TAKEN}, l AS (SELECT item_id, item_id AS root FROM kept WHERE source_id IS NULL AND match_score IS NOT NULL UNION ALL SELECT e.node, l.root FROM e JOIN l ON e.parent = l.item_id)
 SELECT k.item_id, CASE WHEN k.source_id IS NULL THEN NULL ELSE coalesce(l.root, k.source_id) END AS source_id, CAST(coalesce(s.match_score, k.match_score) AS DOUBLE) AS match_score FROM kept k LEFT JOIN l USING (item_id) LEFT JOIN kept s ON s.item_id = l.root"""
)
def lineage_repair(r: Roles) -> DataFrame:
    """Both steps of the repair: siblings have their root's score and name the root."""
    return lineage.repair(_taken(r), F.col("method") == "legacy_sibling")[0].select("item_id", "source_id", "match_score")


@query(f"WITH RECURSIVE {TAKEN}, l AS (SELECT item_id, item_id AS root FROM kept WHERE source_id IS NULL AND match_score IS NOT NULL UNION ALL SELECT e.node, l.root FROM e JOIN l ON e.parent = l.item_id) SELECT CAST((SELECT count(*) FROM gone) AS BIGINT) AS deleted, CAST(count(*) AS BIGINT) AS updated FROM l WHERE item_id <> root")
def lineage_repair_counts(r: Roles) -> DataFrame:
    counts = lineage.repair(_taken(r), F.col("method") == "legacy_sibling")[1]
    return r.spark.createDataFrame([(counts["deleted"], counts["updated"])], "deleted bigint, updated bigint")


@query(with_views("fetch_log", f"WITH k AS (SELECT item_id, {KIND} AS kind FROM fetch_log) SELECT item_id, CASE WHEN kind = 'ok' AND item_id % 4 = 1 THEN 'not_found' WHEN kind = 'ok' AND item_id % 4 = 2 THEN 'blocked' WHEN kind = 'ok' AND item_id % 4 = 3 THEN 'parse_error' ELSE kind END AS word FROM k"))
def ledger_words(r: Roles) -> DataFrame:
    """Pages by what they hold: a details page, a missing one, an interstitial, anything else."""
    which = F.col("item_id") % 4
    html = F.when(which == 0, '<div class="detailsdiv">').when(which == 1, '<div class="errordiv">').when(which == 2, "<b>Just a moment...</b>").otherwise("<p>captcha</p>")
    page = r.fetch_log.withColumn("html", html)
    has = {n: pages.has_any(F.col("html"), m) for n, m in (("valid", outcomes.DETAIL_MARKERS), ("soft", outcomes.MISSING_MARKERS), ("challenged", outcomes.CHALLENGE_MARKERS))}
    kind = outcomes.outcome_kind(F.col("status"), has["valid"], has["challenged"])
    return page.withColumn("kind", kind).select("item_id", outcomes.ledger_kind(F.col("kind"), has["soft"], has["challenged"]).alias("word"))


@query(with_views("attempts", "WITH o AS (SELECT item_id, CASE WHEN match_score > 0.5 THEN 'matched' ELSE 'unmatched' END AS status, item_id + 5 AS work_id FROM attempts WHERE attempted_at < DATE '1999-01-01') SELECT a.item_id, CASE WHEN o.item_id IS NULL THEN a.work_id WHEN o.status = 'matched' THEN o.work_id END AS work_id, coalesce(o.status, a.status) AS status, CASE WHEN o.item_id IS NULL THEN a.attempts ELSE a.attempts + 1 END AS attempts, CASE WHEN o.item_id IS NULL THEN CAST(a.attempted_at AS TIMESTAMP) ELSE TIMESTAMP '2024-01-01' END AS attempted_at, CASE WHEN o.item_id IS NULL THEN CAST(a.next_retry_at AS TIMESTAMP) WHEN o.status = 'unmatched' THEN TIMESTAMP '2024-01-01 06:00:00' END AS next_retry_at FROM attempts a LEFT JOIN o USING (item_id)"))
def recorded_outcomes(r: Roles) -> DataFrame:
    stored = r.attempts.select("item_id", "work_id", "status", "method", "match_score", "attempts", F.col("attempted_at").cast("timestamp").alias("attempted_at"), F.col("next_retry_at").cast("timestamp").alias("next_retry_at"))
    status = F.when(F.col("match_score") > 0.5, "matched").otherwise("unmatched")
    new = r.attempts.where("attempted_at < DATE '1999-01-01'").select("item_id", (F.col("item_id") + 5).alias("work_id"), status.alias("status"), F.lit("search").alias("method"), "match_score")
    new = new.withColumn("wait", F.when(F.col("status") == "unmatched", 6 * 3600))
    return mutations.record_outcomes(stored, new, F.lit("2024-01-01").cast("timestamp")).select("item_id", "work_id", "status", "attempts", "attempted_at", "next_retry_at")


@query(with_views("attempts", """WITH n AS (SELECT item_id, item_id - 1 AS source_id FROM attempts WHERE status = 'unmatched') SELECT a.item_id, coalesce(n.source_id, a.work_id) AS work_id, CASE WHEN n.item_id IS NULL THEN a.method ELSE 'resolution_sibling' END AS method, CASE WHEN n.item_id IS NULL THEN a.status ELSE 'matched' END AS status, CASE WHEN n.item_id IS NULL THEN a.match_score ELSE 0.75 END AS match_score, a.attempts + CASE WHEN n.item_id IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN n.item_id IS NOT NULL THEN '[{"source_item_id":' || n.source_id || '}]' END AS candidates, CASE WHEN n.item_id IS NOT NULL THEN 1 END AS candidate_count FROM attempts a LEFT JOIN n USING (item_id)"""))
def saved_reuse(r: Roles) -> DataFrame:
    stored = r.attempts.withColumns({"attempted_at": F.col("attempted_at").cast("timestamp"), "next_retry_at": F.col("next_retry_at").cast("timestamp"), "candidates": F.lit(None).cast("string"), "candidate_count": F.lit(None).cast("int")})
    new = r.attempts.where("status = 'unmatched'").select("item_id", (F.col("item_id") - 1).alias("work_id"), "group_key", (F.col("item_id") - 1).alias("source_id"), F.lit(0.75).alias("match_score"))
    return mutations.save_reused(stored, new, F.lit("2024-01-01").cast("timestamp")).select("item_id", "work_id", "method", "status", "match_score", "attempts", "candidates", "candidate_count")


@query("SELECT l_orderkey AS item_id, l_linenumber AS k, coalesce(CASE WHEN l_linenumber = 1 THEN l_returnflag END, CASE WHEN l_linenumber = 2 THEN l_linestatus END, 'none') AS filled FROM lineitem")
def backfilled(r: Roles) -> DataFrame:
    rows = r.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("k"), F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).alias("filled"), F.when(F.col("l_linenumber") == 2, F.col("l_linestatus")).alias("other"))
    return mutations.backfilled(rows, "filled", F.col("other"), F.lit("none")).drop("other")


@query(with_views("items", "WITH top AS (SELECT max(item_id) AS h FROM items), w AS (SELECT unnest(range(h + 1, h + 41)) AS item_id, 'frontier' AS phase FROM top UNION ALL SELECT unnest(range(h + 1 - 50, h + 1)), 'backward' FROM top) SELECT item_id, phase FROM w WHERE phase = 'frontier' AND item_id NOT IN (SELECT item_id FROM items) UNION ALL (SELECT item_id, 'refresh' FROM items ORDER BY added_at, item_id LIMIT 20)"))
def planned_cycle(r: Roles) -> DataFrame:
    highest = r.items.agg(F.max("item_id")).first()[0]
    items = r.items.select("item_id", "added_at", F.col("added_at").alias("next_refresh_at"))
    ledger = r.spark.createDataFrame([], "item_id bigint, status string, next_retry_at date")
    return scan.plan_cycle(r.spark, scan.ScanState(highest=highest), items, ledger, F.lit("2024-01-01").cast("date"), 500, 40, 50, 20)


@query("WITH w AS (SELECT o_orderkey // 10 AS n, bool_and(o_orderstatus <> 'P') AS old FROM orders GROUP BY 1), f AS (SELECT 1000000 - n * 10 AS floor, old FROM w), g AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE 1 END) OVER (ORDER BY floor DESC) AS run FROM f) SELECT floor, CASE WHEN old THEN first_value(floor) OVER (PARTITION BY run, old ORDER BY floor DESC) END AS anchor, old AND first_value(floor) OVER (PARTITION BY run, old ORDER BY floor DESC) - floor >= 20 AS complete FROM g")
def anchored_floors(r: Roles) -> DataFrame:
    """Floors going down, each with whether its window is old: where a run of old windows began, and whether it is long enough."""
    windows = r.table("orders").groupBy(F.floor(F.col("o_orderkey") / 10).alias("n")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("confirmed"))
    floors = windows.select((1000000 - F.col("n") * 10).alias("floor"), "confirmed")
    return scan.anchored(floors, 20).select("floor", "anchor", "complete")
