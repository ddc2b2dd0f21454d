import math
import re
import zlib
from collections import Counter

from lodeworks.llm import queries, url_filter

CLASS = {c: k for k, cs in enumerate(url_filter._CLASSES) for c in cs} | {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def brute_codes(url):
    ids = [31] * 3 + [CLASS.get(c, 31) for c in url or ""]
    return [((ids[i - 3] * 32 + ids[i - 2]) * 32 + ids[i - 1]) * 32 + ids[i] for i in range(3, len(ids))]


def brute(urls):
    rows = []
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
        path, best = m[2] if m else "", None
        for how, r in queries.URL_RULES:
            h, p = r.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
                best = (how, r)
        rows.append((u, host, path, best))
    known = [(u, b[0]) for u, _, _, b in rows if b]
    train = [(brute_codes(u), v) for u, v in known if zlib.crc32(u.encode()) % 5]
    counts = {v: Counter(c for cs, w in train if w == v for c in cs) for v in ("allow", "block")}

    def p(v, code, k):
        if k == 0:
            return 1 / 32
        own = own_counts[v, k]
        context = contexts[v, k].get(code >> 5)
        lower = p(v, code % 32 ** (k - 1), k - 1)
        return lower if context is None else (own.get(code, 0) + context[1] * lower) / (context[0] + context[1])

    own_counts, contexts = {}, {}
    for v in counts:
        for k in range(1, 5):
            c = Counter()
            for code, n in counts[v].items():
                c[code % 32**k] += n
            own_counts[v, k] = c
            con = {}
            for code, n in c.items():
                a, b = con.get(code >> 5, (0, 0))
                con[code >> 5] = (a + n, b + 1)
            contexts[v, k] = con
    score = lambda u: sum(math.log(p("allow", c, 4) / p("block", c, 4)) for c in brute_codes(u)) / max(1, len(u or ""))
    return rows, score


def test_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = {r.page_id: r for r in queries.op3_url_filter(spark, "/root/testdata/sf0.001").collect()}
    rows, score = brute(list(urls.values()))
    assert got.keys() == urls.keys()
    allowed, blocked = [], []
    for page, (u, host, path, rule) in zip(urls, rows):
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None)
        assert abs(r.score - score(u)) < 1e-3
        if rule:
            assert r.verdict == rule[0]
        else:
            (allowed if r.verdict == "allow" else blocked).append(r.score)
    assert not allowed or not blocked or min(allowed) > max(blocked)


def test_odd_rows_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (4, "HTTP://WWW.Example.COM/en/x?q#f"), (None, "x://é.net/es/" + "y" * 100_000), (6, "a://com"), (7, "a://b.com?x/"), (8, "a://example.com/en/\n"), (9, "a://notexample.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS codes", "'x' AS verdict")
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path[:12], r.rule) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None)
    assert by[4] == ("www.example.com", "/en/x", "www.example.com/en/") and by[None][2] == "net/es/"
    assert by[6] == ("com", "", None) and by[7] == ("b.com", "", None)
    assert by[8][2] == "example.com/en/" and by[9][2] == "com/"
    assert all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0
