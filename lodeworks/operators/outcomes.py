"""What a request's outcome means, when to try again, and the pace of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400
#: Seconds of a first cooldown, its ceiling, and that after a brief fault.
COOLDOWN, COOLDOWN_CAP, BRIEF = 60, 900, 5
#: Kinds that block a host and kinds after which it rests briefly.
BLOCKING = ("blocked", "challenge")
BRIEF_KINDS = ("server_error", "timeout", "connection_error")
#: Texts that only interstitial pages hold, those of details pages, and that of a page that says "not found".
CHALLENGE_MARKERS = (
    "cf-browser-verification",
    "_cf_chl_opt",
    'id="challenge-form"',
    "cf-error-details",
    "Attention Required! | Cloudflare",
    "Just a moment...",
)
DETAIL_MARKERS = ('class="detailsdiv"', 'class="detailsdescr"')
MISSING_MARKERS = ('class="errordiv"',)


def outcome_kind(status: Column, valid: Column | None = None, challenged: Column | None = None) -> Column:
    """Kind of a response, by status and what its page holds."""
    valid, challenged = F.lit(True) if valid is None else valid, F.lit(False) if challenged is None else challenged
    return (
        F.when(status.isNull(), "connection_error")
        .when(status == 404, "not_found")
        .when(status.isin(301, 302, 303, 307, 308), "redirect")
        .when(status.isin(403, 429), "blocked")
        .when(status >= 500, "server_error")
        .when(status != 200, "unexpected_status")
        .when(valid, "ok")
        .when(challenged, "challenge")
        .otherwise("unrecognized")
    )


def ledger_kind(kind: Column, soft_missing: Column | None = None, challenged: Column | None = None) -> Column:
    """The ledger's word for a kind of outcome."""
    soft, challenged = (F.lit(False) if c is None else c for c in (soft_missing, challenged))
    unclear = kind.isin("unrecognized", "unexpected_status")
    return F.when(unclear & soft, "not_found").when(kind == "challenge", "blocked").when(unclear & challenged, "blocked").when(unclear, "parse_error").otherwise(kind)


def http_text(status: Column, location: Column) -> Column:
    """``302->place``, or the status alone."""
    return F.when(location.isNotNull(), F.concat(status.cast("string"), F.lit("->"), location)).otherwise(status.cast("string"))


def refresh_seconds(age: Column) -> Column:
    """How long until an item of this age, in seconds, is read again."""
    return F.when(age < 7 * DAY, 6 * HOUR).when(age < 30 * DAY, DAY).otherwise(7 * DAY)


def unmatched_seconds(attempts: Column) -> Column:
    """Wait after a search without match; attempts as before this one."""
    return F.when(attempts < 2, 6 * HOUR).when(attempts < 4, DAY).when(attempts < 7, 7 * DAY).otherwise(30 * DAY)


def error_seconds(status: Column) -> Column:
    return F.when(status == 429, 15 * MINUTE).otherwise(HOUR)


def ledger_retry_seconds(status: Column) -> Column:
    """Wait by ledger status; null: never."""
    return F.when(status == "frontier_missing", 5 * MINUTE).when(status == "internal_gap", 30 * DAY).when(status.isin("transient_error", "parse_error"), 15 * MINUTE)


def cooldowns(log: DataFrame, order: list[str], start: int = COOLDOWN, cap: int = COOLDOWN_CAP) -> DataFrame:
    """``log`` (host, kind, retry_after) with the seconds that its host rests after each request.

    A block rests for what the server asks, if that is more than zero, else for a time that doubles with each
    block in a row; both are capped. Brief faults rest for five seconds, all else for none; whatever is no
    block ends the row of blocks.
    """
    by_host = Window.partitionBy("host").orderBy(*order)
    blocked = F.col("kind").isin(*BLOCKING)
    islands = log.withColumn("_run", F.sum(F.when(blocked, 0).otherwise(1)).over(by_host.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.when(blocked, 1).otherwise(0)).over(Window.partitionBy("host", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    doubled = F.least(F.lit(cap), F.lit(start) * F.pow(F.lit(2), F.least(F.col("_nth") - 1, F.lit(20)))).cast("bigint")
    asked = F.when(F.col("retry_after") > 0, F.least(F.lit(cap), F.col("retry_after")))
    rest = F.when(blocked, F.coalesce(asked, doubled)).when(F.col("kind").isin(*BRIEF_KINDS), BRIEF).otherwise(0)
    return islands.withColumn("_nth", nth).withColumn("cooldown", rest.cast("bigint")).drop("_run", "_nth")


def pacing(log: DataFrame, order: list[str], gap: float, at: str = "at") -> DataFrame:
    """``log`` with the start of each request of a host if starts lie ``gap`` seconds apart at least."""
    by_host = Window.partitionBy("host").orderBy(*order)
    n = F.row_number().over(by_host) - 1
    lag = F.col(at) - F.col("_n") * gap
    numbered = log.withColumn("_n", n).withColumn("_lag", lag)
    start = F.max("_lag").over(by_host.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * gap
    return numbered.withColumn("start", start.cast("double")).drop("_n", "_lag")


def resting_events(resting: DataFrame) -> DataFrame:
    """(at, change): when hosts start and stop to rest; overlapping rests of one host count once.

    ``resting``: host, begin, end. One host's rests are put in order by one task.
    """
    before = Window.partitionBy("host").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = resting.withColumn("_reach", F.max("end").over(before))
    opened = reach.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col("begin")), 1).otherwise(0))
    piece = Window.partitionBy("host").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    merged = opened.withColumn("_piece", F.sum("_new").over(piece)).groupBy("host", "_piece").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    ends = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change"))))
    return merged.select(ends.alias("e")).select("e.at", "e.change")


def all_resting(resting: DataFrame, hosts: int, span: int = DAY) -> DataFrame:
    """(at): moments at which the last of ``hosts`` hosts starts to rest as well, each once.

    Moments are swept within spans of time, so that no task has to hold a whole log in order; how many
    hosts rest when a span begins is the sum of all spans before it, one row each.
    """
    moments = resting_events(resting).groupBy("at").agg(F.sum("change").alias("change")).withColumn("_span", F.floor(F.col("at") / span))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = moments.groupBy("_span").agg(F.sum("change").alias("_sum")).select("_span", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    sweep = Window.partitionBy("_span").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    now = moments.join(carried, "_span").withColumn("_now", F.col("_carried") + F.sum("change").over(sweep))
    return now.where((F.col("_now") >= hosts) & (F.col("_now") - F.col("change") < hosts)).select("at")
