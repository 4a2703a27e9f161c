from pandwerk.llm import url_filter

CASES = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme casino": ("", "", None, "allow"),
    "http://A.Example.ORG/x?y": ("a.example.org", "/x", "org/", "allow"),
    "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
    "http://www.example.org/en/19": ("www.example.org", "/en/19", "example.org/en/1", "block"),
    "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://x.com/fr/casino-poker-xxx": ("x.com", "/fr/casino-poker-xxx", "com/fr/", "allow"),
    "http://org": ("org", "", None, "allow"), "http://x.net/porn": ("x.net", "/porn", None, "block"),
    "http://x.net/pornography": ("x.net", "/pornography", None, "allow"), "http://x.net/CASINO/a_poker?z#q": ("x.net", "/CASINO/a_poker", None, "block"),
    "http://x.net/casino/casino": ("x.net", "/casino/casino", None, "allow"), "ftp://h?q=://b": ("h", "", None, "allow"),
    "http://x.net/casino-win": ("x.net", "/casino-win", None, "block"), "http://x.net/win/win-win": ("x.net", "/win/win-win", None, "allow"),
    "http://x.net/" + "a" * 100_000 + "/xxx": ("x.net", "/" + "a" * 100_000 + "/xxx", None, "block"),
}


def test_rules_and_vocabulary(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(CASES)] + [(None, "http://x.net/porn", None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, Path int")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["url"]]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_names_that_clash_or_hold_dots(spark):
    pages = spark.createDataFrame([(1, "http://x.net/cheap-pills", "t", 2)], "page_id long, url string, _terms string, `a.b` int")
    got = url_filter.judge_urls(pages)
    assert got.columns[:4] == ["page_id", "url", "_terms", "a.b"] and got.first()["verdict"] == "block"


def test_without_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://x.net/porn")], "page_id long, url string")
    assert url_filter.judge_urls(pages, strict=(), soft={"zzz": 1.0}).first()["verdict"] == "allow"
    assert url_filter.judge_urls(pages, strict=(), soft={}).first()["soft_hits"] == 0
