import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.catalogue import Catalogue, NotFound
from lodeworks.config import REMOVED, ConfigError, EngineConfig, origin
from lodeworks.operators import catalogue, lineage, mapping, matching, mutations, outcomes, scan, selection
from lodeworks.plans import registry
from lodeworks.sources import store as store_module
from lodeworks.sources.roles import Roles
from lodeworks.sources.store import SnapshotStore
from lodeworks.sources.tables import StoredTables, database_table
from lodeworks.streaming import replay


SF = "/root/testdata/sf0.001"


def test_cooldowns_escalate_reset_and_cap(spark):
    kinds = ["blocked"] * 3 + ["ok"] + ["blocked"] * 6 + ["server_error", "blocked", "blocked"]
    rows = [("h", k, kind, 0 if k == 11 else 1000 if k == 12 else None) for k, kind in enumerate(kinds)]
    log = spark.createDataFrame(rows, "host string, at int, kind string, retry_after int")
    got = [r.cooldown for r in outcomes.cooldowns(log, ["at"]).orderBy("at").collect()]
    assert got == [60, 120, 240, 0, 60, 120, 240, 480, 900, 900, 5, 60, 900]


def test_pacing_spans(spark):
    log = spark.createDataFrame([("h", i, 0) for i in range(10)], "host string, n int, at int")
    for gap, span in ((2, 18.0), (1, 9.0)):
        assert outcomes.pacing(log, ["n"], gap).agg(F.max("start")).first()[0] == span


def test_all_resting_counts_each_transition_once(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("b", 5, 8), ("a", 9, 12), ("b", 11, 20)], "host string, begin int, end int")
    for span in (86400, 10, 6, 1):  # the state carries over from span to span
        assert sorted(r["at"] for r in outcomes.all_resting(rows, 2, span).collect()) == [5, 11]


def test_outcome_words(spark):
    status = [200, 404, 301, 403, 429, 500, 418, None]
    rows = spark.createDataFrame([(s,) for s in status], "status int")
    assert [r.k for r in rows.select(outcomes.outcome_kind(F.col("status")).alias("k")).collect()] == ["ok", "not_found", "redirect", "blocked", "blocked", "server_error", "unexpected_status", "connection_error"]
    words = spark.createDataFrame([("challenge",), ("unrecognized",), ("redirect",)], "k string")
    assert [r.w for r in words.select(outcomes.ledger_kind(F.col("k"), F.col("k") == "unrecognized").alias("w")).collect()] == ["blocked", "not_found", "redirect"]


def _pairs(spark, rows):
    d = datetime.date(2024, 1, 10)
    out = [(1, i, i, ["a", "b", "c", "d"], d, t, day and d + datetime.timedelta(day - 1), s) for i, (t, day, s) in enumerate(rows)]
    schema = "item int, candidate_id int, pos int, tokens array<string>, day date, candidate_tokens array<string>, candidate_day date, site_match boolean"
    return matching.scored(spark.createDataFrame(out, schema))


def test_decisions(spark):
    whole, half, none = ["a", "b", "c", "d"], ["a", "b", "x", "y"], ["x"]
    cases = {
        "accepted": [(whole, 1, True), (half, 1, False)],
        "ambiguous": [(whole, 1, True), (whole, 1, True)],
        "rejected": [(half, 31, False), (none, None, False)],
    }
    for reason, rows in cases.items():
        got = matching.decisions(_pairs(spark, rows), ["item"]).first()
        assert (got.reason, got.candidate_id, got.candidate_count) == (reason, 0, 2)
    once = matching.distinct_candidates(_pairs(spark, cases["ambiguous"]), ["item"], ["candidate_tokens", "candidate_day"])
    assert matching.decisions(once, ["item"]).first().reason == "accepted"
    best = matching.audit(_pairs(spark, cases["accepted"]), ["item"], 1).first().audit
    assert [(a.id, a.score, a.accepted) for a in best] == [(0, 1.0, True)]


def test_selected_row_survives_the_cut(spark):
    rows = spark.createDataFrame([([(k, k == 28) for k in range(30)],)], "a array<struct<id:int,selected:boolean>>")
    kept = rows.select(matching.kept_audit(F.col("a")).alias("a")).first().a
    assert [e.id for e in kept] == [*range(24), 28]


def test_site_selection(spark):
    rows = [(1, 0, 7, "Other", "", "Great Site"), (1, 1, 8, "great-site", "", "Great Site"), (2, 0, 9, "Only", "", "x"), (3, 0, 1, "a", "", "x"), (3, 1, 2, "b", "", "x")]
    got = matching.select_site(spark.createDataFrame(rows, "item_id int, pos int, site_id int, name string, short_name string, label string"))
    assert {r.item_id: r.site_id for r in got.collect()} == {1: 8, 2: 9}


def test_reuse_of_stored_matches(spark):
    """The latest independent match of another item, with batch and stored ids the same."""
    day = lambda n: datetime.date(2024, 1, n)
    stored = [(1, "k", "matched", "search", 0.9, day(1), 10), (2, "k", "matched", "search", 0.8, day(5), 20), (3, "k", "matched", "resolution_sibling", 0.9, day(8), 20), (4, "k", "matched", "parse_filename_first", 0.9, day(9), 40), (5, "k", "matched", "search", 0.9, day(9), None), (6, "k", "unmatched", "search", 0.9, day(9), 1), (7, "k", "matched", "search", None, day(9), 1), (8, "z", "matched", "legacy_sibling", 0.7, day(1), 5)]
    table = spark.createDataFrame(stored, "item_id int, group_key string, status string, method string, match_score double, attempted_at date, work_id int")
    batch = table.select("item_id", "group_key", F.col("item_id").alias("place"), F.lit(False).alias("accepted")).unionAll(spark.createDataFrame([(9, "z", 9, False), (10, None, 10, False)], "a int, b string, c int, d boolean"))
    got = {r.item_id: r.source_id for r in matching.with_reuse(batch, table).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: None, 9: 8, 10: None}


def test_pairs_of_enough_common_words_are_all_found(spark):
    r = random.Random(1)
    words = ["a", "b", "c", "the", "of", "alpha", "beta", "gamma", "delta", "omega"]
    sets = lambda n: [(i, r.sample(words, r.randint(0, 7))) for i in range(n)]
    left, right = sets(60), sets(40)
    for share in (0.3, 0.5, 1.0):
        want = {(i, j) for i, a in left for j, b in right if a and b and len({*a} & {*b}) >= share * min(len(a), len(b))}
        tables = (spark.createDataFrame(x, f"{k} int, tokens array<string>") for x, k in ((left, "source_id"), (right, "candidate_id")))
        assert want <= {tuple(p) for p in matching.likely_pairs(*tables, share).collect()}


def test_pairs_with_few_common_words_are_left_out(spark):
    """One long word in common is no match of a set of six, nor the long words of a larger set that a smaller one holds too few of."""
    words = [f"w{i}" for i in range(9)]
    left = [(1, ["longestword", *words]), (2, ["longestword", "otherlong", "third1", *words]), (3, ["longestword", "x", "y"])]
    right = [(1, ["longestword", "otherlong", "third1", "a", "b", "c"]), (2, [*words, "z", *[f"longword{i}" for i in range(20)]])]
    tables = (spark.createDataFrame(x, f"{k} int, tokens array<string>") for x, k in ((left, "source_id"), (right, "candidate_id")))
    assert {tuple(p) for p in matching.likely_pairs(*tables, 0.5).collect()} == {(1, 2), (2, 1), (2, 2)}


def test_pairs_of_large_sets_are_all_found(spark):
    r = random.Random(2)
    words = [f"{'abcdefgh'[i % 8] * (1 + i % 8)}{i}" for i in range(60)]
    sets = lambda n: [(i, r.sample(words, r.randint(0, 50))) for i in range(n)]
    left, right = sets(80), sets(50)
    for share in (0.2, 0.5, 0.9):
        want = {(i, j) for i, a in left for j, b in right if a and b and len({*a} & {*b}) >= share * min(len(a), len(b))}
        tables = (spark.createDataFrame(x, f"{k} int, tokens array<string>") for x, k in ((left, "source_id"), (right, "candidate_id")))
        assert want <= {tuple(p) for p in matching.likely_pairs(*tables, share).collect()}


def test_a_cascade_makes_its_candidates_once(spark):
    plan = registry.QUERIES["cascade_first_accept"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(tokens") == 2  # all words of sources and of candidates
    sorts = [line for line in plan.splitlines() if "Window [" in line]
    assert sorts and not any("tokens" in line for line in sorts)


def test_the_site_that_is_found_is_expected_later(spark):
    day = datetime.date(2024, 1, 1)
    sources = spark.createDataFrame([(1, "Great Site", ["a", "b", "c", "d"], day), (2, "Other", ["a", "b", "c", "d"], day)], "item_id int, label string, tokens array<string>, day date")
    sites = spark.createDataFrame([(1, 0, 7, "great-site", "-"), (2, 0, 8, "x", "-"), (2, 1, 9, "y", "-")], "item_id int, pos int, site_id int, name string, short_name string")
    half = ["a", "b", "x", "y"]
    rows = [(i, stage, 0, 10 * i + stage, f"t{stage}", half, day, 7, "renamed", "-") for i in (1, 2) for stage in (0, 1, 2)]
    candidates = spark.createDataFrame(rows, "item_id int, stage int, pos int, candidate_id int, title string, tokens array<string>, day date, site_id int, site_name string, site_short_name string")
    got = {r.item_id: (r.stage, r.candidate_id, r.candidate_count) for r in matching.cascade(sources, candidates, sites).collect()}
    assert got == {1: (1, 11, 2), 2: (None, None, 2)}  # by name alone, no stage would accept; without a site its stage isn't asked


def test_reuse_within_a_batch(spark):
    batch = spark.createDataFrame([(1, "k", 0, False), (2, "k", 1, True), (3, "k", 2, False), (4, "k", 3, True), (5, "z", 4, False)], "item_id int, group_key string, place int, accepted boolean")
    none = spark.createDataFrame([], "item_id int, group_key string, status string, method string, match_score double, attempted_at date, work_id int")
    got = {r.item_id: r.source_id for r in matching.with_reuse(batch, none).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: 2, 5: None}


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [(1, None, "w", "k", 0.9, "search"), (2, 1, "w", "k", None, "resolution_sibling"), (3, 2, "w", "k", None, "resolution_sibling"), (4, None, "w", None, None, "legacy_sibling"), (5, 4, "w", None, 0.1, "resolution_sibling"), (6, 5, "v", None, 0.1, "resolution_sibling"), (7, 8, "w", "c", 0.2, "x"), (8, 7, "w", "c", 0.2, "x")]
    rows += [(100 + i, 99 + i if i else None, "w", "long", 0.5 if not i else 0.0, "x") for i in range(150)]
    return spark.createDataFrame(rows, "item_id int, source_id int, work_id string, group_key string, match_score double, method string")


def test_lineage_repair(attempts):
    after, counts = lineage.repair(attempts, F.col("method") == "legacy_sibling")
    got = {r.item_id: (r.source_id, r.match_score) for r in after.collect()}
    assert 4 not in got and 5 not in got and got[6] == (5, 0.1)
    assert got[1] == (None, 0.9) and got[2] == got[3] == (1, 0.9) and got[7] == (8, 0.2)
    assert got[249] == (100, 0.5) and counts == {"deleted": 2, "updated": 151}


def test_closure_of_long_chains_and_of_graphs(spark):
    chain = spark.range(1, 20_001).selectExpr("id AS node", "id - 1 AS parent")
    assert lineage.closure(spark.createDataFrame([(5_000,)], "node bigint"), chain).count() == 15_001
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (4, 9), (6, 5), (None, 1), (7, None)], "node bigint, parent bigint")
    assert {r.node for r in lineage.closure(spark.createDataFrame([(3,), (5,), (None,)], "node bigint"), edges).collect()} == {3, 4, 5, 6}
    assert {r.node for r in lineage.closure(spark.createDataFrame([(2,)], "node bigint"), edges, pieces=1).collect()} == {1, 2, 3, 4}
    loop = edges.where("node < 3")
    assert lineage.closure(spark.createDataFrame([(9,)], "node bigint"), loop).count() == 1
    assert {r.node for r in lineage.closure(spark.createDataFrame([(2,)], "node bigint"), loop).collect()} == {1, 2}


def test_reused_matches_and_bundles_are_saved(spark, tmp_path):
    schema = "item_id int, work_id int, group_key string, status string, method string, match_score double, candidates string, candidate_count int, attempts int, attempted_at timestamp, next_retry_at timestamp"
    when = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame([(1, None, "k", "unmatched", "search", None, None, 7, 3, None, None)], schema)
    new = spark.createDataFrame([(1, 5, "k", 9, 0.8), (2, 5, "k", 9, 0.8)], "item_id int, work_id int, group_key string, source_id int, match_score double")
    rows = {r.item_id: r for r in mutations.save_reused(old, new, when).collect()}
    assert (rows[1].attempts, rows[2].attempts, rows[1].status, rows[1].candidate_count) == (4, 1, "matched", 1)
    assert rows[2].candidates == '[{"source_item_id":9}]' and rows[1].next_retry_at is None
    store = SnapshotStore(spark, str(tmp_path / "store"))
    part = {n: spark.createDataFrame([(1, "a")], f"{k} int, name string") for n, k in (("networks", "network_id"), ("sites", "site_id"), ("works", "work_id"), ("people", "person_id"))}
    part["bridge"] = spark.createDataFrame([(1, 1, 0)], "work_id int, person_id int, ordinal int")
    outcome = spark.createDataFrame([(1, 1, "matched", "search", 0.9, None)], "item_id int, work_id int, status string, method string, match_score double, wait int")
    none = spark.createDataFrame([], "item_id int, work_id int, status string, method string, match_score double, attempts int, attempted_at timestamp, next_retry_at timestamp")
    assert mutations.write_bundle(store, part, none, outcome, when) == 1
    again = {n: df.withColumn("name", F.lit("b")) if n != "bridge" else df.withColumn("person_id", F.lit(2)) for n, df in part.items()}
    assert mutations.write_bundle(store, again, store.read("attempts"), outcome, when) == 2
    assert store.read("works").first().name == "b" and store.read("works", 1).first().name == "a"
    assert [r.person_id for r in store.read("bridge").collect()] == [2] and store.read("attempts").first().attempts == 2


def test_mutations(spark):
    ledger = spark.createDataFrame([(1, "gone", 2), (2, "frontier_missing", 1)], "item_id int, status string, attempts bigint")
    more = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "item_id int, status string, at int")
    got = {tuple(r) for r in mutations.apply_ledger(ledger, more, ["at"]).collect()}
    assert got == {(1, "b", 4), (2, "frontier_missing", 1), (3, "c", 1)}
    assert {r.status for r in mutations.reclassify(ledger, F.lit(2)).collect()} == {"gone", "frontier_missing"}
    added = mutations.insert_missing(ledger, ledger.withColumn("item_id", F.col("item_id") + 1), "item_id")
    assert sorted(r.item_id for r in added.collect()) == [1, 2, 3]
    twice = ledger
    for _ in range(2):
        twice = mutations.upsert(twice, ledger.where("item_id = 2").withColumn("status", F.lit("new")), "item_id", keep=["attempts"])
    assert {tuple(r) for r in twice.collect()} == {(1, "gone", 2), (2, "new", 1)}
    outcome = spark.createDataFrame([(1, 9, "unmatched", "m", 0.0, 60)], "item_id int, work_id int, status string, method string, match_score double, wait int")
    none = spark.createDataFrame([], "item_id int, work_id int, status string, method string, match_score double, attempts int, attempted_at timestamp, next_retry_at timestamp")
    row = mutations.record_outcomes(none, outcome, F.lit("2024-01-01").cast("timestamp")).first()
    assert row.work_id is None and row.attempts == 1 and row.next_retry_at == datetime.datetime(2024, 1, 1, 0, 1)


def test_scan(spark):
    state = scan.ScanState(highest=100, floor=60, scan_high=110)
    assert scan.frontier_window(state, 50, 30) == (111, 130) and scan.backward_window(state, 500) == (1, 60)
    held = scan.advance(state, 40, True, 30, 9)
    assert held.anchor == 40 and scan.advance(held, 10, True, 30, 9).completed == 9 and scan.advance(held, 10, False, 30, 9).anchor is None
    items = spark.createDataFrame([(i, datetime.date(2020, 1, 1), None) for i in (1, 2, 5, 3_000_000)], "item_id bigint, added_at date, next_refresh_at date")
    assert {tuple(r) for r in scan.gaps(items).collect()} == {(3, 4), (6, 2_999_999)}
    ledger = spark.createDataFrame([(3, "gone", None), (4, "transient_error", datetime.date(2020, 1, 1))], "item_id bigint, status string, next_retry_at date")
    plan = scan.plan_cycle(spark, scan.ScanState(highest=5, floor=5), items, ledger, F.lit("2021-01-01").cast("date"), lookahead=3, dry_streak=2)
    assert {tuple(r) for r in plan.collect()} == {(4, "retry"), (6, "frontier"), (7, "frontier")}
    assert not scan.window_is_old(items, ledger, 1, 5, F.lit("2021-01-01").cast("date")).first().confirmed
    assert scan.window_is_old(items, ledger, 1, 3, F.lit("2021-01-01").cast("date")).first().confirmed


def test_bootstrap_and_anchors(spark):
    first = scan.bootstrapped(scan.ScanState(), 100, 50)
    assert (first.cutoff, first.floor, first.scan_high) == (100, 50, 49) and scan.bootstrapped(scan.ScanState(), 100, 0).floor == 1
    done = scan.ScanState(highest=9, floor=3, cutoff=100, completed=7, anchor=5)
    assert scan.bootstrapped(done, 100, 50) == done
    earlier = scan.bootstrapped(done, 90, 50)
    assert (earlier.cutoff, earlier.completed, earlier.anchor, earlier.floor) == (90, None, None, 3)
    r = random.Random(4)
    floors = [(1000 - 7 * k, r.random() < 0.8) for k in range(60)]
    state, want = scan.ScanState(), {}
    for floor, old in floors:
        state = scan.advance(scan.ScanState(anchor=state.anchor), floor, old, 20, 1)
        want[floor] = (state.anchor, state.completed is not None)
    table = spark.createDataFrame(floors, "floor int, confirmed boolean")
    for span in (1_000_000, 50, 7):
        assert {x.floor: (x.anchor, x.complete) for x in scan.anchored(table, 20, span).collect()} == want


def test_reader_surface(spark):
    read = Catalogue(Roles(spark, SF))
    listing = read.list_items(page="99")
    assert listing.page.page == 99 and listing.records.count() == 0 and listing.total == listing.total_all == 1500
    assert read.list_entities("people", page="x").page.page == 1 and read.list_entities("works", " ", " ").total == 150
    assert {*read.list_items().facets} == {"categories", "tags"} and not read.list_entities("sites").facets
    assert read.get_item(3).first().item_id == 3 and read.get_entity("networks", "1").parts["sites"].count() == 5
    for ask in (lambda: read.get_item("x"), lambda: read.get_item(10**9), lambda: read.get_entity("works", "no"), lambda: read.get_entity("works", 10**9), lambda: read.get_entity("films", 1), lambda: read.list_entities("films")):
        with pytest.raises(NotFound):
            ask()


def test_text_keys_have_to_be_uuids(spark):
    class Tables:
        works = spark.createDataFrame([("0b0e7c5e-0000-4000-8000-000000000001", "T")], "work_id string, title string")

    read = Catalogue(Tables)
    assert read._key(Tables.works, "work_id", "{0B0E7C5E000040008000000000000001}") == "0b0e7c5e-0000-4000-8000-000000000001"
    with pytest.raises(NotFound):
        read._key(Tables.works, "work_id", "17")


def test_images_of_people(spark):
    rows = [("a", "", None, '["p", {"url": "q"}, {"url": 5}, 7, null, "a"]', '{"profile": {"image": "r", "face": 4, "posters": ["s", {"url": "t"}]}, "site_profile": {"thumbnail": "u", "posters": null}}'), (None, None, None, "bad", "bad"), (None, "f", None, None, '{"profile": []}')]
    table = spark.createDataFrame(rows, "image_url string, face_url string, thumbnail_url string, posters string, metadata string")
    assert [r.i for r in table.select(catalogue.person_images().alias("i")).collect()] == [["a", "p", "q", "r", "s", "t", "u"], [], ["f"]]


def test_selection(spark):
    rows = spark.createDataFrame([(1, "Some Title", None, "A", ["x", "y"], 5), (2, None, "title-giver", "B", None, None), (3, "z", None, "A", [], 9)], "item_id int, title string, uploader string, category string, tags array<string>, size_bytes int")
    ids = lambda c: {r.item_id for r in rows.where(c).collect()}
    assert ids(selection.item_filter("TITLE")) == {1, 2} and ids(selection.item_filter("", None, "x")) == {1} and ids(selection.item_filter()) == {1, 2, 3}
    assert ids(selection.holds_all(F.col("tags"), ["y", "x"])) == {1} and ids(selection.due(F.col("size_bytes"), F.lit(5))) == {1}
    order = selection.sort_columns(selection.ITEM_ORDERS, "largest", "item_id")
    assert [r.item_id for r in selection.page_of(rows, order).collect()] == [3, 1, 2]
    page = selection.PageInfo.of("x", 50)
    assert (page.page, page.pages, page.start, page.end) == (1, 3, 1, 24) and selection.PageInfo.of(9, 50).page == 3 and page.url("/a", q="", tag="t") == "/a?tag=t&page=1"


def test_details_and_facets(spark):
    tags = spark.createDataFrame([(["a", "a", " "],), (None,), ([],)], "tags array<string>")
    assert {tuple(r) for r in catalogue.tag_facets(tags, nonblank=True).collect()} == {("a", 2)}
    with pytest.raises(KeyError):
        catalogue.one(tags.selectExpr("1 AS id"), "id", 5)
    row = spark.sql("SELECT 'b' AS x, array('c', '', 'b', null) AS y")
    assert row.select(catalogue.merged_images(F.array("x"), F.col("y")).alias("i")).first().i == ["b", "c"]


def test_bundles(spark):
    raw = '{"id":"w","_id":3,"title":"T","date":"2024-01-02","site":{"id":1,"name":"S","network_id":5,"parent":{"id":5,"name":"N"}},"performers":[{"id":10,"name":"p"},{"id":11,"name":"q","parent":{"id":12,"name":"Q","extras":{"birthday":"1990-01-01"}}},{"id":10,"name":"p"}],"tags":[{"name":"a"},{"name":""},{}]}'
    got = mapping.bundle(spark.createDataFrame([(raw,), ('{"id":"x","title":"no number"}',)], "raw_json string"))
    assert [tuple(r) for r in got["networks"].select("network_id", "name").collect()] == [(5, "N")]
    assert [(r.work_id, r.site_id, r.tags) for r in got["works"].collect()] == [("w", 1, ["a"])]
    assert {tuple(r) for r in got["bridge"].collect()} == {("w", 10, 0), ("w", 12, 1)}
    lists = mapping.candidate_rows(spark.createDataFrame([(1, '{"data": [{"a":1}]}'), (2, "[]")], "q int, raw_json string")).collect()
    assert [(r.q, r.total, r.error, r.pos) for r in sorted(lists, key=lambda r: r.q)] == [(1, 1, False, 0), (2, None, True, None)]


def test_store_keeps_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.version() == 0
    store.write({"t": spark.range(3)})
    store.write({"t": store.read("t").where("id > 0")})
    assert store.version() == 2 and store.read("t").count() == 2 and store.read("t", 1).count() == 3


def test_a_version_is_there_whole_or_not(spark, tmp_path, monkeypatch):
    one, two = (SnapshotStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.write({"t": spark.range(3)})
    monkeypatch.setattr(one, "version", lambda: 0)  # it hasn't seen the other's version
    with pytest.raises(FileExistsError):
        one.write({"t": spark.range(9)})
    monkeypatch.undo()

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(store_module, "publish", crash)
    with pytest.raises(OSError):
        one.write({"t": spark.range(9)})
    monkeypatch.undo()
    assert two.version() == 1 and two.read("t").count() == 3 and one.write({"t": spark.range(5)}) == 2


def test_stored_tables_serve_the_reader(spark, tmp_path):
    roles, store = Roles(spark, SF), SnapshotStore(spark, str(tmp_path / "store"))
    kept = {n: getattr(roles, n) for n in ("networks", "sites", "works", "people", "bridge", "attempts")}
    store.write({**kept, "items": roles.listed_items})
    one, two = Catalogue(roles), Catalogue(StoredTables(store))
    for ask in (lambda c: c.list_entities("works", sort="newest").records, lambda c: c.list_items(sort="seeders").records, lambda c: c.get_entity("works", 7).parts["items"].select("item_id", "title"), lambda c: c.list_entities("works").records):
        assert list(map(tuple, ask(one).collect())) == list(map(tuple, ask(two).collect()))
    with pytest.raises(AttributeError):
        StoredTables(store).films


def test_database_tables_are_read_in_ranges(spark):
    url, driver = "jdbc:derby:memory:lodeworks;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(5, 105).selectExpr("id AS ITEM_ID", "id * 2 AS TWICE").write.jdbc(url, "ITEMS", "overwrite", driver)
    rows = database_table(spark, url, "ITEMS", "ITEM_ID", 4, **driver)
    assert rows.rdd.getNumPartitions() == 4 and rows.where("ITEM_ID >= 100").agg(F.sum("TWICE")).first()[0] == 2 * sum(range(100, 105))
    assert database_table(spark, url, "ITEMS", **driver).count() == rows.count() == 100
    spark.range(0).selectExpr("id AS ITEM_ID").write.jdbc(url, "NONE_", "overwrite", driver)
    assert database_table(spark, url, "NONE_", "ITEM_ID", **driver).count() == 0


def test_ledger_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, 5, 404), (1, 6, 429), (2, 5, 200)], "item_id bigint, at bigint, status int").coalesce(1)
    for _ in range(2):
        log.write.mode("append").parquet(str(tmp_path / "log"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # a second start finds nothing new
        query = replay.keep_ledger(replay.read_log(spark, str(tmp_path / "log"), log.schema), store, str(tmp_path / "cp"))
        query.awaitTermination(120)
    assert [tuple(r) for r in store.read("ledger").collect()] == [(1, "blocked", 4)]


RATE = "REQUESTS_PER_SECOND_PER_DOMAIN"
BAD = [{RATE: v} for v in ("0", "-1", "inf", "nan", "-inf", "abc", "0.001")]
BAD += [{k: v} for k in ("BLOCK_COOLDOWN_SECONDS", "REQUEST_TIMEOUT_SECONDS") for v in ("0", "-5", "inf", "nan", "x")]
BAD += [{"BASE_URLS": v} for v in ("https://a.x,", "ftp://a.x", "a.x", "https://u:p@a.x", "https://a.x/path", "https://a.x?q=1", "https://", "https://a.x,https://A.X/", "https://a.x:no")]
BAD += [{k: "1"} for k in REMOVED] + [{"CYCLE_INTERVAL": "1.5"}]


@pytest.mark.parametrize("env", BAD)
def test_bad_settings(env):
    with pytest.raises(ConfigError, match=None if "BASE_URLS" in env else next(iter(env))):
        EngineConfig.from_mapping(env)


def test_settings():
    got = EngineConfig.from_mapping({"BASE_URLS": " https://A.x , http://b:8080/", RATE: "0.5", "BACKFILL_CHUNK_SIZE": "9", "MAX_CONCURRENCY": "", "SITE_TZ": ""})
    assert got.hosts == ("https://a.x", "http://b:8080") and got.gap == 2 and got.chunk == 9 and got.site_zone == "UTC" and origin("https://q") == "https://q"
    assert EngineConfig.from_mapping({"BASE_URL": "https://one"}).hosts == ("https://one",) and EngineConfig.from_mapping({}) == EngineConfig()
