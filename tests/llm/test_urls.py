from pyspark.sql import functions as F

from tessera.llm import urls

from . import plain

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y=1", "https://example.net/en", "https://example.net/en/", "https://sub.example.net/de/1#f", "http://net/", "http://ne.t/", "http://xnet/", "http://example.com/de/a/b", "http://x.org/fr/", "http://x.org/fr",
    "ftp://h?://q/net/", "a://b://c.net/x", "http://x.net", "http://x.net?a/b", "http://ÄÖ.org/fr/é", "http://x.net:80/", "x" * 50000 + "://example.com/de/", "http://casino.example.com/1\n2", "http://x.net/a\nb",
]


def rule_of(host, path):
    best = None
    for verdict, rule in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def test_host_path_and_rule(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(4, URLS[4], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    model = urls.fit(pages.selectExpr("url", "page_id % 2 AS label"), trees=2, depth=2)
    got = urls.judge(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = plain.host_and_path(URLS[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), URLS[r.page_id]
        assert r.verdict == (rule[0] if rule else "block" if r.score >= 0.5 else "allow")


def test_trees_learn(spark):
    rows = [(f"http://www.site{k % 7}.example.com/a/{k}", 0) for k in range(150)] + [(f"http://x{k * 7919 % 1000}-9{k}.example.org/p?a={k}&b=1&c=2", 1) for k in range(50)]
    train = spark.createDataFrame(rows, "url string, label int")
    model = urls.fit(train, trees=4, depth=2)
    assert 0 < len(model.trees) <= 4
    new = spark.createDataFrame([(1, "http://www.other.example.com/b/5"), (2, "http://x5-99.example.org/p?a=1&b=2&c=9")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(new, model, rules=()).collect()}
    assert got == {1: "allow", 2: "block"}


def test_held_out(spark):
    """What was learnt holds on URLs kept from training; labels by chance teach nothing."""
    rows = [(f"http://www.site{k % 40}.example.{'net' if k % 3 else 'org'}/" + ("a/" * (k % 5)) + f"{k}" + ("?q=1&s=2" if k % 2 else ""), k % 2, (k * 7919) % 101 % 2) for k in range(1200)]
    pages = spark.createDataFrame(rows, "url string, label int, chance int").withColumn("page_id", F.monotonically_increasing_id())
    out = urls.held_out(pages)
    for label, low, high in (("label", 0.95, 1.0), ("chance", 0.35, 0.65)):
        model = urls.fit(pages.where(~out).select("url", F.col(label).alias("label")), trees=3, depth=2)
        judged = urls.judge(pages.where(out), model).join(pages.select("page_id", F.col(label).alias("label")), "page_id")
        assert low <= urls.area(judged) <= high


def test_area(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.8, 1), (0.2, 0)]
    pairs = [(a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y]
    assert abs(urls.area(spark.createDataFrame(rows, "score double, label int")) - sum(pairs) / len(pairs)) < 1e-12
    assert urls.area(spark.createDataFrame(rows[:1], "score double, label int")) is None


def test_labels_come_from_the_page(spark):
    html = ["<title>quiet words of a page here</title>", "<title>LOUD WORDS OF A PAGE, HERE</title>", "a ### b *** c $$$ d", "# * $ ###", None]
    pages = spark.createDataFrame([(f"http://casino.example/{k}", h) for k, h in enumerate(html)], "url string, html string")
    assert [r.label for r in urls.page_labels(pages).orderBy("url").collect()] == [0, 1, 1, 0, None]


def test_bounds_and_empty(spark):
    none = spark.createDataFrame([], "url string, label int")
    model = urls.fit(none)
    pages = spark.createDataFrame([(1, "http://a.example/")], "page_id long, url string")
    assert model.trees == [] and urls.judge(pages, model).first().verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), model).count() == 0
    assert urls.fit(spark.createDataFrame([("http://a/", 1)] * 5, "url string, label int")).trees == []


def test_no_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = urls.judge(pages, urls.fit(urls.page_labels(pages), trees=1, depth=1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
