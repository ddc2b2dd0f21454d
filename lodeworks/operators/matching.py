"""Entity resolution: score candidates, decide, reuse decisions of siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import date_delta, overlap, plain_name

MARGIN, AUDIT_ROWS, STORED_ROWS = 0.08, 10, 25
#: Common words among those looked up that make a pair a candidate, where a match needs as many.
LOOKED_UP = 4
#: The method of a match that was taken over, and of one that isn't independent either.
REUSED = ("resolution_sibling", "parse_filename_first")


def site_matches(label: Column, name: Column, short_name: Column, expected_id: Column | None = None, site_id: Column | None = None) -> Column:
    """The expected id is the site's, or its normalised name or short name is the label's; an empty label equals a missing name."""
    by_name = (plain_name(label) == plain_name(name)) | (plain_name(label) == plain_name(short_name))
    if expected_id is None:
        return by_name
    return F.when(expected_id.isNotNull(), F.coalesce(expected_id.cast("string") == site_id.cast("string"), F.lit(False)) | by_name).otherwise(by_name)


def select_site(results: DataFrame, label: str = "label") -> DataFrame:
    """(item_id, site_id): the first search result whose name equals the label, else a sole result."""
    exact = site_matches(F.col(label), F.col("name"), F.col("short_name"))
    by = results.groupBy("item_id").agg(F.min_by("site_id", F.when(exact, F.col("pos"))).alias("exact"), F.count(F.lit(1)).alias("n"), F.min("site_id").alias("only"))
    return by.select("item_id", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("site_id")).where("site_id IS NOT NULL")


def score(share: Column, site: Column, delta: Column) -> Column:
    """0.35 of the word overlap, 0.35 for the site, up to 0.30 for the date."""
    near = F.when(delta == 0, 0.30).when(delta <= 3, 0.20).when(delta <= 7, 0.10).otherwise(0.0)
    return share * 0.35 + F.when(site, 0.35).otherwise(0.0) + near


def acceptable(share: Column, site: Column, delta: Column) -> Column:
    """Whether overlap, site and days apart suffice, by any of four rules."""
    same_day = (delta == 0) & (share >= 0.5) & (site | (share >= 0.8))
    near = (delta <= 3) & (share >= 0.8) & (site | (share >= 0.9))
    week = site & (delta <= 7) & (share >= 0.8)
    month = site & (share >= 0.95) & (delta <= 30)
    return F.coalesce(same_day, F.lit(False)) | F.coalesce(near, F.lit(False)) | F.coalesce(week, F.lit(False)) | F.coalesce(month, F.lit(False))


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (tokens, candidate_tokens or overlap; day, candidate_day, site_match) with overlap, delta, score and accepted."""
    out = pairs if "overlap" in pairs.columns else pairs.withColumn("overlap", overlap(F.col("tokens"), F.col("candidate_tokens")))
    out = out.withColumn("delta", date_delta(F.col("day"), F.col("candidate_day")))
    o, s, d = F.col("overlap"), F.col("site_match"), F.col("delta")
    return out.withColumns({"score": score(o, s, d), "accepted": acceptable(o, s, d)})


def distinct_candidates(candidates: DataFrame, key: list[str], same: list[str], pos: str = "pos") -> DataFrame:
    """The first of candidates that agree in what they say."""
    first = Window.partitionBy(*key, *same).orderBy(pos)
    return candidates.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def decisions(candidates: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the best candidate, whether it is accepted, and why.

    ``candidates``: key, candidate_id, pos, score, delta, accepted. Ranked by score, then days apart (unknown last),
    then position. An accepted one needs a margin over the next accepted one. One sort by key serves the
    order of accepted candidates and the sums.
    """
    rank = F.struct((-F.col("score")).alias("s"), F.coalesce(F.col("delta"), F.lit(10**9)).alias("d"), F.col("pos").alias("p"))
    ranked = candidates.withColumn("_rank", rank)
    ranked = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("accepted"), "_rank")))
    named = F.struct("candidate_id", "score")
    by = ranked.groupBy(*key).agg(
        F.min_by(named, "_rank").alias("best"),
        F.max(F.when(F.col("accepted") & (F.col("_nth") == 1), named)).alias("first"),
        F.max(F.when(F.col("accepted") & (F.col("_nth") == 2), F.col("score"))).alias("second"),
        F.count(F.lit(1)).alias("candidate_count"),
    )
    margin = F.when(F.col("second").isNull(), 1.0).otherwise(F.round(F.col("first.score") - F.col("second"), 9))
    sure = F.col("first").isNotNull() & (margin >= MARGIN)
    reason = F.when(F.col("first").isNull(), "rejected").when(sure, "accepted").otherwise("ambiguous")
    return by.select(
        *key,
        F.coalesce("first.candidate_id", "best.candidate_id").alias("candidate_id"),
        F.coalesce("first.score", "best.score").alias("score"),
        sure.alias("accepted"),
        reason.alias("reason"),
        "candidate_count",
    )


def likely_pairs(sources: DataFrame, candidates: DataFrame, share: float) -> DataFrame:
    """(source_id, candidate_id): all pairs whose sets of tokens overlap by ``share`` of the smaller one, and few others.

    ``sources``: source_id, tokens; ``candidates``: candidate_id, tokens; tokens without repeats. If
    k of the smaller set's n tokens have to be in the other set, c of any n - k + c of them are, so these alone are looked up, with c
    ``LOOKED_UP`` or k: the longest, since long words are in few sets, and so no frequent word is a key but for sets of nothing else.
    Only the smaller set of a pair is looked up, and of sources only those that are smaller than the largest candidate.
    """

    def every(rows, key, n):
        # outer, since a plain explode would put a filter of its own below the rows' exchange, which then couldn't be shared
        return rows.select(key, F.size("tokens").alias(n), F.explode_outer("tokens").alias("w")).where("w IS NOT NULL")

    def few(rows, key, n):
        longest = F.sort_array(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("w"))))
        size = F.size("tokens")
        k = F.greatest(F.ceil(size * share - 1e-9).cast("int"), F.lit(1))
        need = F.least(k, F.lit(LOOKED_UP))
        return rows.select(key, size.alias(n), need.alias("need"), F.explode_outer(F.slice(longest, 1, size - k + need)).alias("e")).select(key, n, "need", "e.w").where("w IS NOT NULL")

    most = candidates.agg(F.max(F.size("tokens")).alias("most"))
    short = sources.join(F.broadcast(most), F.size("tokens") < F.col("most"))  # one row
    smaller_source = few(short, "source_id", "n").join(every(candidates, "candidate_id", "m"), "w").where("n < m")
    smaller_candidate = every(sources, "source_id", "n").join(few(candidates, "candidate_id", "m"), "w").where("m <= n")
    both = smaller_source.select("source_id", "candidate_id", "need").unionByName(smaller_candidate.select("source_id", "candidate_id", "need"))
    return both.groupBy("source_id", "candidate_id").agg(F.count(F.lit(1)).alias("found"), F.min("need").alias("need")).where("found >= need").drop("found", "need")


def audit(candidates: DataFrame, key: list[str], limit: int = AUDIT_ROWS) -> DataFrame:
    """(key, audit): the best ``limit`` candidates as structs, scores rounded to four places."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("delta"), F.asc("pos"))
    kept = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    entry = F.struct("rank", F.col("candidate_id").alias("id"), F.bround("score", 4).alias("score"), "accepted")
    return kept.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("audit"))


def kept_audit(entries: Column, limit: int = STORED_ROWS) -> Column:
    """The first ``limit`` entries; if the selected one lies beyond, it takes the last place."""
    late = F.get(F.filter(F.slice(entries, limit + 1, F.greatest(F.size(entries), F.lit(1))), lambda e: e["selected"]), F.lit(0))
    head = F.slice(entries, 1, limit)
    return F.when(late.isNull(), head).otherwise(F.concat(F.slice(entries, 1, limit - 1), F.array(late)))


def cascade(sources: DataFrame, candidates: DataFrame, site_results: DataFrame, site_stage: int = 1, last: int = 5) -> DataFrame:
    """Every item's decision at the first stage that accepts, as ``first_accepted`` gives it.

    ``sources``: item_id, label, tokens, day; ``candidates``: item_id, stage, pos, candidate_id, title, tokens, day, site_id,
    site_name, site_short_name, and overlap in place of tokens on both sides if it is known; ``site_results``: item_id, pos, site_id, name, short_name. The site that the
    results of a search by label name is the expected one from ``site_stage`` on, and without it that stage has no
    candidates. Candidates that agree in title, day and site count once within a stage. Stages beyond ``last`` aren't asked.
    """
    labelled = site_results.join(sources.select("item_id", "label"), "item_id")
    site = select_site(labelled).select("item_id", F.col("site_id").alias("_expected"))
    asked = candidates.where(F.col("stage") <= last).withColumnRenamed("tokens", "candidate_tokens").withColumnRenamed("day", "candidate_day")
    words = [] if "overlap" in candidates.columns else ["tokens"]
    joined = asked.join(sources.select("item_id", "label", "day", *words), "item_id").join(site, "item_id", "left")
    joined = joined.where((F.col("stage") != site_stage) | F.col("_expected").isNotNull())
    if words:  # before the windows, which needn't sort tokens then
        joined = joined.withColumn("overlap", overlap(F.col("tokens"), F.col("candidate_tokens"))).drop("tokens", "candidate_tokens")
    joined = joined.withColumns({"_title": plain_name(F.col("title")), "_site": plain_name(F.col("site_name"))})
    joined = joined.withColumn("_inspected", F.count(F.lit(1)).over(Window.partitionBy("item_id", "stage")))
    once = distinct_candidates(joined, ["item_id", "stage"], ["_title", "candidate_day", "_site"])
    expected = F.when(F.col("stage") >= site_stage, F.col("_expected"))
    match = site_matches(F.col("label"), F.col("site_name"), F.col("site_short_name"), expected, F.col("site_id"))
    by = decisions(scored(once.withColumn("site_match", match)), ["item_id", "stage", "_inspected"]).drop("candidate_count")
    return first_accepted(by.withColumnRenamed("_inspected", "candidate_count"))


def first_accepted(by_stage: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per item: the first stage that accepts, with the candidates seen up to there.

    ``by_stage``: key, stage, candidate_id, score, accepted, candidate_count. Without acceptance the
    score is 0 and all candidates count.
    """
    joined = by_stage.withColumn("at", F.min(F.when(F.col("accepted"), F.col("stage"))).over(Window.partitionBy(key)))
    upto = F.col("at").isNull() | (F.col("stage") <= F.col("at"))
    here = F.col("stage") == F.col("at")
    out = joined.groupBy(key).agg(
        F.max("at").alias("stage"),
        F.max(F.when(here, F.col("candidate_id"))).alias("candidate_id"),
        F.coalesce(F.max(F.when(here, F.col("score"))), F.lit(0.0)).alias("score"),
        F.coalesce(F.sum(F.when(upto, F.col("candidate_count"))), F.lit(0)).cast("bigint").alias("candidate_count"),
    )
    return out.withColumn("status", F.when(F.col("stage").isNotNull(), "matched").otherwise("unmatched"))


def eligible(items: DataFrame, attempts: DataFrame, categories: list[str], as_of: Column, limit: int) -> DataFrame:
    """Items to match: of these categories, never tried or due again, the newest first."""
    joined = items.where(F.col("category").isin(categories)).join(attempts.select("item_id", "status", "next_retry_at", "attempts"), "item_id", "left")
    again = F.col("status").isin("unmatched", "error", "no_file") & F.col("next_retry_at").isNotNull() & (F.col("next_retry_at") <= as_of)
    chosen = joined.where(F.col("status").isNull() | again)
    return chosen.select("item_id", "title", "category", F.coalesce("attempts", F.lit(0)).alias("attempts"), "added_at").orderBy(F.desc("added_at"), F.desc("item_id")).limit(limit)


def shadow(items: DataFrame, attempts: DataFrame, categories: list[str], ids: list[int] | None, limit: int) -> DataFrame:
    """For a dry run: named items in the order named, or the newest that are untried or unmatched."""
    joined = items.join(attempts.select("item_id", "status"), "item_id", "left")
    if ids is not None:
        listed = F.lit(ids).cast("array<bigint>")
        return joined.where(F.col("item_id").isin(ids)).withColumn("place", F.array_position(listed, F.col("item_id"))).orderBy("place", "item_id").limit(limit)
    fresh = joined.where(F.col("category").isin(categories) & (F.col("status").isNull() | (F.col("status") == "unmatched")))
    return fresh.withColumn("place", F.lit(0).cast("bigint")).orderBy(F.desc("added_at"), F.desc("item_id")).limit(limit)


def reusable(attempts: DataFrame) -> DataFrame:
    """(group_key, item_id, work_id, match_score, place): each key's latest two matches that stand on their own, newest first.

    The second serves the item that the first belongs to.
    """
    own = attempts.where((F.col("status") == "matched") & F.col("work_id").isNotNull() & ~F.col("method").isin(*REUSED) & F.col("match_score").isNotNull())
    latest = Window.partitionBy("group_key").orderBy(F.desc("attempted_at"), F.desc("item_id"))
    return own.withColumn("place", F.row_number().over(latest)).where("place <= 2").select("group_key", "item_id", "work_id", "match_score", "place")


def with_reuse(batch: DataFrame, attempts: DataFrame, place: str = "place") -> DataFrame:
    """``batch`` (item_id, group_key, place, accepted, ...) with source_id: whose match each item reuses.

    The latest stored match of another item comes first; else the first item of the batch with the key that
    accepts on its own serves all behind it, as if they had been worked off in order. A null key reuses nothing.
    """
    stored = reusable(attempts).groupBy("group_key").agg(F.max(F.when(F.col("place") == 1, F.col("item_id"))).alias("_newest"), F.max(F.when(F.col("place") == 2, F.col("item_id"))).alias("_next"))
    other = F.when(F.col("_newest") == F.col("item_id"), F.col("_next")).otherwise(F.col("_newest"))
    first = batch.where("accepted").groupBy("group_key").agg(F.min_by("item_id", place).alias("_leader"), F.min(place).alias("_at"))
    within = F.when(F.col(place) > F.col("_at"), F.col("_leader"))
    out = batch.join(stored, "group_key", "left").join(first, "group_key", "left")
    return out.withColumn("source_id", F.coalesce(other, within)).drop("_newest", "_next", "_leader", "_at")


def assembled(batch: DataFrame) -> DataFrame:
    """``batch`` (filename, source_id, error_status, stage) with the recorded status and method."""
    status = F.when(F.col("filename").isNull(), "no_file").when(F.col("source_id").isNotNull(), "matched").when(F.col("error_status").isNotNull(), "error").when(F.col("stage").isNotNull(), "matched").otherwise("unmatched")
    method = F.when(F.col("filename").isNull(), "none").when(F.col("source_id").isNotNull(), REUSED[0]).when(F.col("stage").isNull(), "exhausted").otherwise(F.concat(F.lit("stage_"), F.col("stage").cast("string")))
    return batch.withColumns({"status": status, "method": method})


def report_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per row, keys sorted."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("line"))
