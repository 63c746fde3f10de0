import random

from sweetframe.llm import url_filter


def plain(url, rules, default="allow"):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
        path = path.split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), -i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i % 7 if i % 3 else None, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string").repartition(3)
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place int")
    got = sorted(map(str, url_filter.judge(pages, table, **more).collect()))
    want = sorted(str(__import__("pyspark").sql.Row(page_id=i % 7 if i % 3 else None, host=h, path=p, rule=r, verdict=v)) for i, u in enumerate(urls) for h, p, r, v in [plain(u, rules)])
    assert got == want


def test_edge_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/")]
    urls = [None, "", "no scheme", "http://", "https://NET/", "http://x.NET", "http://a.b.Example.net/en/x?y", "ftp://example.net/en", "http://notexample.com/de/", "http://example.com/de/#a", "://org/fr/a/b", "http://.net/", "http://a..net//", "http://org?/fr/", "http://ÄÖ.org/fr/é", "http://net/" + "a" * 50_000, "http://net/\U0010ffff\U0010ffff"] * 2
    check(spark, urls, rules)
    check(spark, urls, rules, rows_per_sweep=1)


def test_random_nested_rules(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    host = lambda n: ".".join(word() for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "/".join(word() for _ in range(rng.randint(0, n)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(2), path(2)) for _ in range(60))}.values())
    check(spark, [f"http://{host(4)}{path(4)}" for _ in range(800)], rules, rows_per_sweep=50)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string, place int")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
