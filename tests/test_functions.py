import datetime
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import formatters, pages, text


@pytest.fixture(scope="module")
def value(spark):
    def of(expression, row=None):
        """The value of a column over one row."""
        rows = spark.createDataFrame([row], ", ".join(f"c{k} string" for k in range(len(row)))) if row else spark.range(1)
        return rows.select(expression.alias("x")).first().x

    return of


def test_sizes(value):
    c = F.col("c0")
    full = {"1,019.30 MB": int(1019.30 * 1024**2), "12 MB trailing junk": None, "7": 7, "3 KiB": 3072, "2 bytes": 2, "1.2.3 MB": None, "5 XB": None, "": None, None: None}
    assert {t: value(text.size_to_bytes(c), (t,)) for t in full} == full
    plain = {"1.5 GB": int(1.5 * 1024**3), "12 MB trailing junk": 12 * 1024**2, "1,019 MB": None, "1.2.3 MB": None, "9b": 9, "x": None}
    assert {t: value(text.parse_size(c), (t,)) for t in plain} == plain


def test_largest_file(spark):
    def best(*files):
        rows = spark.createDataFrame([([tuple(f) for f in files],)], "files array<struct<filename:string,size_text:string>>")
        got = rows.select(text.largest_file(F.col("files")).alias("f")).first().f
        return got and tuple(got)

    assert best(("a.mp4", "1 MB"), ("b.mkv", "2 MB"), ("c.zip", "9 GB")) == ("b.mkv", 2 * 1024**2)
    assert best(("a.jpg", "5 MB"), ("b.mp4", "?")) == ("b.mp4", None)
    assert best(("a.mp4", "1 MB"), ("b.mp4", "1 MB")) == ("a.mp4", 1024**2)
    assert best(("", "1 MB")) is None and best() is None


def test_keys_and_tokens(value):
    c = F.col("c0")
    keys = {value(text.group_key(c), (n,)) for n in ("Site.Great.One.1080p.mp4", "x/y\\Site.Great.One.720p.x265.mkv", "site great one WEB-DL.ts")}
    assert keys == {"site.great.one"}
    assert value(text.stored_group_key(c), ("A/Site.One.WEBRip.1080p.mp4",)) == "a.site.one.webrip"
    assert value(text.content_tokens(c), ("The Great E12 scene 3 180 great XXX a1",)) == ["great", "scene", "180", "a1"]
    assert value(text.content_tokens(c, True), ("Great 180 lr",)) == ["great"]
    assert value(text.split_camel(c), ("someSite2Go ABc",)) == "some Site2 Go ABc"
    assert value(text.plain_name(c), ("A-b C!",)) == "abc" and value(text.plain_name(c), (None,)) == ""


def brute_date(tokens):
    for i in range(len(tokens) - 2):
        x, y, z = tokens[i : i + 3]
        if all(re.fullmatch(r"\d\d", t) for t in (x, y)) and re.fullmatch(r"\d\d|\d{4}", z):
            try:
                parts = (2000 + int(x), int(y), int(z)) if len(z) == 2 else (int(z), int(y), int(x))
                return datetime.date(*parts), tokens[i + 3 :]
            except ValueError:
                continue
    return None, tokens


@pytest.mark.parametrize("name", ["site.24.02.29.some.name", "site 23 02 29 x", "a 31 12 2019 b c", "99 99 99 10 11 12", "x 24 1 2", "", "01 02", "24 01 02"])
def test_dates_in_tokens(value, name):
    got = value(text.date_and_rest(text.word_tokens(F.col("c0"))), (name,))
    assert (got.day, got.rest) == brute_date(re.findall("[a-z0-9]+", name))


def test_match_source(value):
    def source(filename, title, category=None):
        return value(text.match_source(F.col("c0"), F.col("c1"), F.col("c2")), (filename, title, category))

    s = source("GreatSite.24.05.06.AnnaBell.Summer.Rain.1080p.mp4", "GreatSite 24 05 07 Anna Bell Summer Rain")
    assert s.site_label == "GreatSite" and s.day == datetime.date(2024, 5, 7)
    assert s.tokens == ["anna", "bell", "summer", "rain"] and s.queries[0] == "anna bell summer rain"
    s = source("x", "")
    assert s.site_label == "" and s.queries == [] and s.day is None
    assert "180" in source("a.180.name.mp4", "t").content and "180" not in source("a.180.name.mp4", "t", "VR/VirtualReality").content


def test_small_parsers(value):
    c = F.col("c0")
    assert value(text.iso_date(c), ("2024-02-30",)) is None and value(text.iso_date(c), ("2024-02-03T01",)) == datetime.date(2024, 2, 3) and value(text.iso_date(c), ("2024-7",)) is None
    assert value(text.uuid(c), ("{0A0B0C0D-0000-1111-2222-333344445555}",)) == "0a0b0c0d-0000-1111-2222-333344445555" and value(text.uuid(c), ("xyz",)) is None
    assert value(text.asset(c, "image"), ('{"image": {"full": "", "large": "L"}}',)) == "L" and value(text.asset(c, "image"), ('{"image": "u"}',)) == "u" and value(text.asset(c, "image"), ("{}",)) is None
    key = 0x5A
    hexes = f"{key:02x}" + "".join(f"{ord(ch) ^ key:02x}" for ch in "High@L5.1")
    assert value(text.xor_text(c), (hexes,)) == "High@L5.1" == pages.unscrambled(hexes)
    assert value(text.page_time(c), ("3 Feb 2024 04:05:06",)) == datetime.datetime(2024, 2, 3, 4, 5, 6) and value(text.page_time(c), ("Pending",)) is None
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [value(text.retry_after(c, now), (t,)) for t in ("12", "inf", "nan", "x", "Mon, 01 Jan 2024 00:01:00 GMT")] == [12.0, None, None, None, 60.0]


def test_formatters(value):
    assert [value(formatters.format_size(F.lit(n))) for n in (0, 1023, 1536, 1024**2, 5 * 1024**4)] == ["0 B", "1023 B", "1.50 KB", "1.00 MB", "5.00 TB"]
    assert [value(formatters.format_duration(F.lit(n))) for n in (0, 61, 3600, 3723)] == ["0s", "1m 1s", "1h", "1h 2m 3s"]
    assert value(formatters.format_date(F.lit(None).cast("date"))) == "Pending" and value(formatters.format_number(F.lit(1234567))) == "1,234,567"
    assert value(formatters.shown(F.lit(""), "Unknown")) == "Unknown"


PAGE = """<div class="detailsdiv"><h1> A title </h1><img class="detailsposter" src="p.jpg"><div class="detailsdescr"><ul>
<li><span>Category</span><span>:</span><span><a>Films</a></span></li><li><span>Size</span><span>:</span><span>1.5 GB</span>
<li><span>Added Date</span><span>:</span><span>1 Jan 2024 10:00:00</span></li><li><span>Peers</span><span>:</span><span><font class="see">7</font><font class="lee">-</font></span></li>
<li><span>Downloads</span><span>:</span><span>n/a</span></li><li><span>Collection</span><span>:</span><span><a>x</a><a>y</a></span></li>
<li class="downloadboxlist"><a href="/torrents/download/AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA">d</a><a href="magnet:?x">m</a></li></ul></div>
<div class="rating-system"><div class="rating"><a class="like"></a><span>3</span></div></div>
<div class="filestable"><ul><li><span>File</span><span>Size</span></li><li><span>a.mp4</span><span>1 GB</span></li></ul></div>
<div class="description">Text<br><br><br><br>more<a href="#"><img src="h/1s/q.jpg"></a>Screenshots :<font style="font-family: monospace">Media Info :<br>General :<br>Format....: MP4<br></font></div></div>"""


def test_page_fields():
    row = pages.parsed(PAGE)
    assert (row["title"], row["category"], row["seeders"], row["leechers"], row["downloads"], row["tags"]) == ("A title", "Films", 7, 0, None, ["x", "y"])
    assert row["info_hash"] == "a" * 40 and row["images"] == ["h/1/q.jpg"] and row["files"] == [{"filename": "a.mp4", "size_text": "1 GB"}]
    assert row["media_info"] == '{"General": {"Format": "MP4"}}' and row["likes"] == 3 and row["image_url"] == "p.jpg"
    assert row["description_text"].startswith("Text\n\nmore")


@pytest.mark.parametrize("gone, error", [("detailsdiv", "missing details"), ("detailsdescr", "missing description list"), ("<h1> A title </h1>", "missing title"), ("magnet:?x", "missing magnet link")])
def test_required_parts(gone, error):
    assert pages.parsed(PAGE.replace(gone, ""))["error"] == error


def test_parse_pages(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("1 Jan 2024 10:00:00", "Pending")), (3, None)], "page_id long, html string")
    got = {r.item_id: r for r in pages.parse_pages(rows, "page_id", "html", "Europe/Berlin").collect()}
    assert got[1].error is None and got[1].added_at == datetime.datetime(2024, 1, 1, 9) and got[1].size_bytes == int(1.5 * 1024**3)
    assert got[2].error == "missing or bad added date" and got[3].error == "missing details"
