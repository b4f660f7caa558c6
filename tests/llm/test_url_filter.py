from scriptorium.llm import url_filter as U

URLS = [
    ("http://a.b.com/en/1?x", "a.b.com", "/en/1", "com/en/", "block"),
    ("https://Example.COM/en/77#t", "example.com", "/en/77", "example.com/en/7", "allow"),
    ("http://x.example.com/en/8", "x.example.com", "/en/8", "com/en/", "block"),
    ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://other.net/de/81", "other.net", "/de/81", "net/de/", "allow"),
    ("http://example.network/de/8", "example.network", "/de/8", None, "allow"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    ("http://a.com:80/en/", "a.com:80", "/en/", None, "allow"),
    ("http://a.com/EN/", "a.com", "/EN/", None, "allow"),
    ("http://a.org?q=/es/", "a.org", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://b.org/es/9", "b.org", "/es/9", "org/es/", "block"),
    ("http://b.org/es/9", "b.org", "/es/9", "org/es/", "block"),
]


def test_rules_and_awkward_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, (u, *_) in enumerate(URLS)] + [(None, None, None, None)], "page_id long, url string, rule string, host int")
    got = {r["page_id"]: tuple(r)[1:5] for r in U.filter_urls(pages).collect()}
    assert {i: e for i, (_, *x) in enumerate(URLS) for e in [tuple(x)]} == {k: v for k, v in got.items() if k is not None}
    assert got[None] == ("", "", None, "allow")
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_index_takes_the_rarest_whole_token():
    index, free = U.build_index(U.RULES, {"com": 9, "en": 8, "example": 1, "net": 7, "de": 2, "org": 3, "es": 5})
    assert index == {"en": [0], "example": [1, 3], "de": [2], "org": [4]} and free == []
    assert "7" not in U.RULES[1].tokens()


def test_free_patterns_match_as_a_plain_scan(spark):
    rules = (U.Rule("", "", False, r"/ads/"), U.Rule("", "", True, r"track(er)?/x"), U.Rule("org", "/", False))
    urls = [f"http://h{i % 3}.{'org' if i % 2 else 'com'}/{p}" for i, p in enumerate(["ads/1", "bads/1", "a/tracker/x", "track/x", "", "q/ads/tracker/x"])]
    got = [r["rule"] for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    import re

    for url, rule in zip(urls, got, strict=True):
        where = url.split("://")[1]
        fits = [r.text for r in rules if re.search(r.pattern, where)]
        assert rule == (max(fits, key=len) if fits else None)
