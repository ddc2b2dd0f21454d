"""URL filtering by host and path rules and a character language-model ratio.

URLs that a rule fits are allowed or blocked by it. They also train two smoothed
variable-order Markov models, one of accepted and one of rejected URLs: characters fall
into 32 classes, contexts hold up to three, and each order is interpolated with the next lower
one by Witten-Bell weights. Every four classes make one of 2**20 codes, so the log-likelihood
ratios of all codes are one array of fixed size, which scoring reads by position. A URL's
score is its mean ratio; the threshold is the one of best balanced accuracy
on labelled URLs that the models haven't seen. All of it is DataFrame functions.
"""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeworks.llm.common import ascii_lower, stored

ORDER, CLASS_BITS = 4, 5
CLASSES = 1 << CLASS_BITS
CODES = CLASSES**ORDER
ROW = 1024  # the array of ratios is an array of rows
#: One character for each class, from A on: letters, digit, slash, dot, dash, mark, other.
_CLASSES = [*string.ascii_lowercase, string.digits, "/", ".", "-_", "?=&#:%", "[]\\^`"]
CALIBRATION_FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty where the URL is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


def codes(url: Column) -> Column:
    """The code of each character of the URL and the three before it."""
    chars = "".join(_CLASSES) + string.ascii_uppercase
    to = "".join(chr(65 + k) * len(c) for k, c in enumerate(_CLASSES)) + string.ascii_uppercase
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), chars, to), r"(?s)[^A-`]", "`")
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    classes = F.concat(F.array(*[F.lit(CLASSES - 1)] * (ORDER - 1)), F.transform(letters, lambda c: F.ascii(c) - 65))
    # held as an array of its own, so that each place is read in constant time
    return F.transform(
        F.filter(F.transform(F.array(classes), lambda a: F.transform(a, lambda x, i: F.when(i >= ORDER - 1, ((F.get(a, i - 3) * CLASSES + F.get(a, i - 2)) * CLASSES + F.get(a, i - 1)) * CLASSES + x))).getItem(0), lambda c: c.isNotNull()),
        lambda c: c.cast("int"),
    )


def ratios(labelled: DataFrame) -> DataFrame:
    """One row with ``ratios``: log P(accepted) - log P(rejected) of every code, in rows of 1024.

    ``labelled``: codes (array<int>), verdict. At most 2**20 different codes are counted.
    """
    spark = labelled.sparkSession
    each = labelled.select(F.explode("codes").alias("code"), (F.col("verdict") == "allow").alias("ok"))
    counts = stored(each.groupBy("code").agg(F.count_if("ok").alias("a"), F.count_if(~F.col("ok")).alias("r")), "url_counts")
    model = spark.range(1).select(F.lit(0).alias("code"), F.lit(1 / CLASSES).alias("pa"), F.lit(1 / CLASSES).alias("pr"))
    for k in range(1, ORDER + 1):
        own = counts.groupBy((F.col("code") % CLASSES**k).alias("code")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = own.groupBy(F.shiftright("code", CLASS_BITS).alias("context")).agg(
            F.sum("a").alias("na"), F.count_if(F.col("a") > 0).alias("ta"), F.sum("r").alias("nr"), F.count_if(F.col("r") > 0).alias("tr")
        )
        lower = model.select(F.col("code").alias("suffix"), "pa", "pr")
        dense = spark.range(CLASSES**k).select(F.col("id").cast("int").alias("code"))
        dense = dense.select("code", F.shiftright("code", CLASS_BITS).alias("context"), (F.col("code") % CLASSES ** (k - 1)).alias("suffix"))
        if k < ORDER:  # at most 2**15 rows each
            own = F.broadcast(own)
        joined = dense.join(own, "code", "left").join(F.broadcast(context), "context", "left").join(F.broadcast(lower), "suffix")

        def smoothed(n, total, types, before):
            n, total, types = (F.coalesce(F.col(c), F.lit(0)) for c in (n, total, types))
            return F.when(total > 0, (n + types * F.col(before)) / (total + types)).otherwise(F.col(before))

        model = joined.select("code", smoothed("a", "na", "ta", "pa").alias("pa"), smoothed("r", "nr", "tr", "pr").alias("pr"))
        if k > 1:
            model = stored(model, "url_model")
    row = model.select(F.floor(F.col("code") / ROW).alias("row"), F.struct("code", F.log(F.col("pa") / F.col("pr")).cast("float").alias("v")).alias("x"))
    rows = row.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("row", F.col("xs.v").alias("vs"))
    return stored(rows.agg(F.sort_array(F.collect_list(F.struct("row", "vs"))).alias("rows")).select(F.col("rows.vs").alias("ratios")), "url_ratios")


def score(own_codes: Column, table: Column) -> Column:
    """Mean log-likelihood ratio over the codes; 0 for none."""
    total = F.aggregate(own_codes, F.lit(0.0), lambda s, c: s + F.get(F.get(table, F.shiftright(c, 10)), c.bitwiseAND(ROW - 1)).cast("double"))
    return total / F.greatest(F.size(own_codes), F.lit(1))


def threshold(scored: DataFrame) -> DataFrame:
    """One row with ``threshold``: of best balanced accuracy over (score, verdict), in steps of 0.01.

    Scores are counted by step, at most 2001 of them. Without rows of either verdict it is 0.
    """
    step = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") * 100)))
    counts = scored.groupBy(step.alias("step")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rate = lambda part, whole: F.coalesce(part, F.lit(0)) / F.greatest(whole, F.lit(1))
    right = rate(F.sum("r").over(before), F.sum("r").over(every)) + rate(F.sum("a").over(after), F.sum("a").over(every))
    both = (F.sum("r").over(every) > 0) & (F.sum("a").over(every) > 0)
    judged = counts.select("step", F.when(both, right).alias("right"))
    return judged.agg(F.coalesce(F.max_by(F.col("step") / 100, F.struct("right", "step")).alias("t"), F.lit(0.0)).alias("threshold"), F.max("right").alias("best")).select(F.when(F.col("best").isNull(), 0.0).otherwise(F.col("threshold")).alias("threshold"))


@contextmanager
def constant(table: DataFrame, column: str):
    """The column's value in a table of one row, as a constant of plans made within the block.

    A constant is shared by all rows of a task; a joined column of this size would be copied for each.
    """
    spark, name = table.sparkSession, f"lodeworks_{uuid.uuid4().hex}"
    kind = table.schema[column].dataType.simpleString()
    spark.sql(f"DECLARE VARIABLE {name} {kind}")
    try:
        spark.sql(f"SET VAR {name} = (SELECT `{column}` FROM {{table}})", table=table)
        yield F.expr(name)
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    ``rules``: (``allow`` or ``block``, host and path such as ``example.com/en/``). A rule
    fits its host and the hosts below it if the URL's path starts with the rule's; the longest wins. Without a
    rule the verdict is ``allow`` if the score reaches the threshold. A null URL counts as an empty one, which
    scores 0. Repeated rows are judged alike; further columns aren't read. Where no
    rule fits any row, all scores and the threshold are 0.
    """
    url = F.col(url_col).cast("string")
    host, path = parts(url)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    known = rows.where("by_rule IS NOT NULL").select(F.col("by_rule").alias("verdict"), codes(F.col("url")).alias("codes"), (F.crc32(F.col("url").cast("binary")) % CALIBRATION_FOLDS == 0).alias("held"))
    table = ratios(known.where("not held"))
    with constant(table, "ratios") as ratios_value:
        own = score(F.col("codes"), ratios_value)
        limit = stored(threshold(known.where("held").select("verdict", own.alias("score"))), "url_threshold")
        scored = rows.withColumn("codes", codes(F.col("url"))).withColumn("score", own).drop("codes")
    by_score = F.when(F.col("score") >= limit.scalar(), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "score")
