"""Text, date and size expressions over columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors, video extensions and the words that say nothing about a title.
SIZE_UNITS = {"b": 0, "byte": 0, "bytes": 0, "kb": 1, "kib": 1, "mb": 2, "mib": 2, "gb": 3, "gib": 3, "tb": 4, "tib": 4}
VIDEO = r"(?i)\.(?:mp4|mkv|avi|wmv|mov|m4v|ts)\z"
QUALITY = r"(?i)(?:[._ -](?:480p|720p|1080p|2160p|4k|uhd|fhd|fullhd|x26[45]|h26[45]|hevc|web[-._ ]?dl|webrip))+\z"
STORED_QUALITY = r"(?i)(?:[._ -](?:480p|720p|1080p|2160p|4k|uhd|fhd|fullhd|x26[45]|h26[45]|hevc))+\z"
NOISE = (
    "a", "aka", "and", "avi", "for", "from", "fhd", "fullhd", "h264", "h265", "hevc", "her", "his", "in", "m4v", "mkv", "mov", "mp4", "my", "nl",
    "of", "on", "p2p", "rm", "the", "to", "ts", "uhd", "web", "webdl", "webrip", "with", "wmv", "wrb", "xc", "x264", "x265", "xxx",
    "480p", "720p", "1080p", "2160p", "4k", "fpv", "gapfill", "narcos", "vaccine", "vsex",
)
SCOPED_NOISE = ("4096", "4096p", "3072", "3072p", "3600", "3600p", "2048", "2048p", "180", "360", "vr180", "vr360", "3dh", "lr", "tb")
SCOPED_CATEGORY = "VR/VirtualReality"
EPISODE = r"^(?:e\d{1,4}|episode\d{1,4}|scene\d{1,4})\z"


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f).getItem(0)


def nonblank(text: Column) -> Column:
    return F.when(text != "", text)


def parse_size(text: Column) -> Column:
    """Bytes of a size that starts the text, such as ``1.5 GB``; no commas, rest ignored; else null."""
    pattern = r"(?i)^\s*([\d.]+)\s*([KMGT]?B)"
    amount = F.regexp_extract(text, pattern, 1).try_cast("double")
    power = F.instr(F.lit("BKMGT"), F.upper(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))) - 1
    return F.floor(amount * F.pow(F.lit(1024.0), power)).cast("bigint")


def size_to_bytes(text: Column) -> Column:
    """Bytes of a whole text with commas and an optional unit; unknown units and other texts are null."""
    pattern = r"^\s*([\d,]+(?:\.\d+)?)\s*([a-zA-Z]+)?\s*\z"
    amount = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.coalesce(nonblank(F.lower(F.regexp_extract(text, pattern, 2))), F.lit("b"))
    factors = F.create_map(*[F.lit(x) for k, p in SIZE_UNITS.items() for x in (k, float(1024**p))])
    return F.floor(amount * F.try_element_at(factors, unit)).cast("bigint")


def is_video(filename: Column) -> Column:
    return filename.rlike(VIDEO)


def largest_file(files: Column) -> Column:
    """struct(filename, size_bytes) of array<struct<filename, size_text>>: a video first, then
    the larger, then the earlier one; size null if unknown, null without a named file."""
    ranked = F.transform(
        files,
        lambda f, i: F.when(
            f["filename"] != "",
            F.struct(is_video(f["filename"]).alias("video"), F.coalesce(size_to_bytes(f["size_text"]), F.lit(-1).cast("bigint")).alias("size"), (-i).alias("at"), f["filename"].alias("filename")),
        ),
    )
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct(best["filename"].alias("filename"), F.when(best["size"] >= 0, best["size"]).alias("size_bytes")))


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def group_key(filename: Column) -> Column:
    """What names of the same content in different qualities share."""
    base = F.lower(F.element_at(F.split(F.coalesce(filename, F.lit("")), r"[/\\]"), -1))
    return F.array_join(word_tokens(F.regexp_replace(F.regexp_replace(base, VIDEO, ""), QUALITY, "")), ".")


def stored_group_key(filename: Column) -> Column:
    """The narrower key that back-fills stored rows: no folders cut off, fewer qualities known."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(filename), VIDEO, ""), STORED_QUALITY, "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "."), F.lit("."))


def telling(tokens: Column, scoped: Column | bool = False) -> Column:
    """Tokens that say something: longer than one, no noise, no episode number; in order, with repeats."""
    scoped = F.lit(scoped) if isinstance(scoped, bool) else F.coalesce(scoped, F.lit(False))
    numbered = lambda t: (t.startswith("e") | t.startswith("s")) & t.rlike(EPISODE)  # noqa: E731  the first letter spares most words the pattern
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*NOISE) & ~(scoped & t.isin(*SCOPED_NOISE)) & ~numbered(t))


def content_tokens(text: Column, scoped: Column | bool = False) -> Column:
    return telling(F.array_distinct(word_tokens(text)), scoped)


def split_camel(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")


def date_and_rest(tokens: Column) -> Column:
    """struct(day, rest): the first valid ``YY MM DD`` or ``DD MM YYYY`` among tokens and what follows it.

    Without a date, day is null and rest all tokens.
    """

    def at(a, i):
        x, y, z = (F.get(a, i + k) for k in range(3))
        two = x.rlike(r"^\d{2}\z") & y.rlike(r"^\d{2}\z")
        short = F.when(two & z.rlike(r"^\d{2}\z"), F.to_date(F.try_to_timestamp(F.concat(F.lit("20"), x, y, z), F.lit("yyyyMMdd"))))
        long = F.when(two & z.rlike(r"^\d{4}\z"), F.to_date(F.try_to_timestamp(F.concat(z, y, x), F.lit("yyyyMMdd"))))
        return F.coalesce(short, long)

    def found(a):
        places = F.when(F.size(a) > 2, F.sequence(F.lit(0), F.size(a) - 3)).otherwise(F.array().cast("array<int>"))
        dated = F.filter(F.transform(places, lambda i: F.struct(at(a, i).alias("day"), i.alias("i"))), lambda d: d["day"].isNotNull())
        return bound(
            F.get(dated, F.lit(0)),
            lambda d: F.struct(d["day"].alias("day"), F.when(d.isNull(), a).otherwise(F.slice(a, F.coalesce(d["i"], F.lit(0)) + 4, F.greatest(F.size(a), F.lit(1)))).alias("rest")),
        )

    return bound(tokens, found)


def plain_name(text: Column) -> Column:
    """Letters a-z and digits of the lower-cased text; null gives an empty text."""
    return F.array_join(word_tokens(text), "")


def match_source(filename: Column, title: Column, category: Column) -> Column:
    """struct(site_label, day, content, tokens, group_key, queries) of an item's file name and title.

    The title's date wins; where both dates differ, or the file name has no content, the title's words are scored.
    """
    scoped = F.coalesce(category == SCOPED_CATEGORY, F.lit(False))
    label = F.coalesce(F.get(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))
    own = F.struct(date_and_rest(word_tokens(split_camel(filename))).alias("file"), date_and_rest(word_tokens(split_camel(title))).alias("title"), label.alias("label"))

    def words(x):
        titled = F.filter(telling(x["title"]["rest"], scoped), lambda t: plain_name(t) != plain_name(x["label"]))
        return F.struct(x["label"].alias("label"), x["file"]["day"].alias("file_day"), x["title"]["day"].alias("title_day"), telling(x["file"]["rest"], scoped).alias("content"), titled.alias("title"))

    def last(a, n):
        return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)

    def made(x):
        content, titled = x["content"], x["title"]
        by_title = F.coalesce(x["title_day"] != x["file_day"], F.lit(False)) | (F.size(content) == 0)
        asked = F.transform(F.array(content, F.slice(content, 1, 3), last(content, 8), titled, F.slice(titled, 1, 3), last(titled, 8)), lambda a: F.array_join(a, " "))
        return F.struct(
            x["label"].alias("site_label"),
            F.coalesce(x["title_day"], x["file_day"]).alias("day"),
            F.array_join(content, " ").alias("content"),
            F.array_distinct(F.when(by_title, titled).otherwise(content)).alias("tokens"),
            group_key(filename).alias("group_key"),
            F.array_distinct(F.filter(asked, lambda q: F.length(q) >= 4)).alias("queries"),
        )

    return bound(bound(own, words), made)


def iso_date(text: Column) -> Column:
    """The date that the first ten characters spell as YYYY-MM-DD, YYYYMMDD, YYYY-Www-D or YYYYWwwD (the day may lack); else null."""

    def week(h):
        year, number, day = (F.regexp_extract(h, r"^(\d{4})-?W(\d{2})-?(\d?)\z", k) for k in (1, 2, 3))
        fourth = F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))  # lies in the first week
        monday = F.date_sub(fourth, F.weekday(fourth))
        of = F.date_add(monday, (number.try_cast("int") - 1) * 7 + F.coalesce(day.try_cast("int"), F.lit(1)) - 1)
        last = F.make_date(year.try_cast("int"), F.lit(12), F.lit(28))  # lies in the last week
        right = number.try_cast("int").between(1, F.weekofyear(last)) & F.coalesce(day.try_cast("int"), F.lit(1)).between(1, 7)
        return F.when(right, of)

    def read(h):
        return (
            F.when(h.rlike(r"^\d{4}-\d{2}-\d{2}\z"), h.try_cast("date"))
            .when(h.rlike(r"^\d{8}\z"), F.regexp_replace(h, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date"))
            .when(h.rlike(r"^\d{4}(?:-W\d{2}(?:-\d)?|W\d{2}\d?)\z") & (F.substring(h, 1, 4) != "0000"), week(h))
        )

    return bound(F.substring(text, 1, 10), read)


def json_list(text: Column, of: str = "string") -> Column:
    """The entries of a JSON list; an empty array for null, bad JSON and all that is no list."""
    plain = F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), text)
    return F.coalesce(F.from_json(plain, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def source_list(item_id: Column) -> Column:
    """``[{"source_item_id": n}]``, as an attempt that was taken over keeps its source."""
    return F.to_json(F.array(F.struct(item_id.alias("source_item_id"))))


def source_of(text: Column) -> Column:
    """The source that such a list names, if it is a whole number; else null."""
    named = F.get_json_object(text, "$[0].source_item_id")
    return F.when(named.rlike(r"^[0-9]+\z"), named.try_cast("bigint"))


def uuid(text: Column) -> Column:
    """Canonical lower-case form of a UUID with or without dashes, braces or prefix; else null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"^urn:|uuid:", ""), r"[{}-]", "")
    return F.when(plain.rlike(r"^[0-9a-f]{32}\z"), F.regexp_replace(plain, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def asset(json: Column, key: str) -> Column:
    """A picture's URL in a JSON record: the text itself, or its full, large or medium form; blanks fall through."""
    value = F.get_json_object(json, f"$.{key}")
    forms = [nonblank(F.get_json_object(json, f"$.{key}.{size}")) for size in ("full", "large", "medium")]
    return F.when(value.startswith("{"), F.coalesce(*forms)).otherwise(nonblank(value))


def xor_text(hexes: Column) -> Column:
    """Hex text whose first byte is the key of all others, decoded."""

    def decoded(h):
        key = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
        places = F.when(F.length(h) >= 4, F.sequence(F.lit(3), F.length(h) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda i: F.char(F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key))), "")

    return bound(hexes, decoded)


def page_time(text: Column, zone: str = "UTC") -> Column:
    """``2 Jan 2024 03:04:05`` of a zone, in UTC; anything else, such as ``Pending``, is null."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit("d MMM yyyy HH:mm:ss")), zone)


def retry_after(text: Column, as_of: Column) -> Column:
    """Seconds of a Retry-After value, a finite number or an HTTP date; else null."""
    number = F.trim(text).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    when = F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(number.isNotNull(), finite).otherwise((when.cast("double") - as_of.cast("double")))


def date_delta(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Common elements by the smaller of two sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
