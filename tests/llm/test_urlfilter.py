from planlake.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://example.com", "http://com/", "http://xcom/",
    "x://y.net/es/a", "x://y.net/es", "x://net/fr/", "a://b://c.com/", "http://?q", "http://user@h.com:80/", "http://h.com/a\nb", "http://.com/", "http://..example.com/en/", "http://EXAMPLE.com/EN/", "http://é.com/é",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[3], "h"), (3, URLS[3], "h")], "page_id long, url string, host string")
    got = sorted(((r["page_id"] is None, r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.rules_frame(spark)).collect() if r["page_id"] is not None)
    want = sorted(((False, i), *plain(u)) for i, u in [*enumerate(URLS), (3, URLS[3])])
    assert got == want
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_frame(spark)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, [(None, "a", "b")]), "block").collect()} == {"block"}


def test_many_rules_take_the_other_join(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    one = sorted(map(repr, urlfilter.judge(pages, urlfilter.rules_frame(spark)).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, urlfilter.judge(pages, urlfilter.rules_frame(spark)).collect())) == one
