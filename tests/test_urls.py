from pyspark.sql import functions as F

from clickatlas.functions import urls


def one(spark, value, fn):
    df = spark.createDataFrame([(v,) for v in value], "u string")
    got = df.select("u", fn(F.col("u")).alias("r")).collect()
    return [r["r"] for r in got]


def test_normalize_url(spark):
    cases = {
        "HTTP://Example.TEST/a/": "http://example.test/a",
        "http://e.test": "http://e.test/",
        "http://e.test/a;p=1?b=2&a=1#f": "http://e.test/a?a=1&b=2",
        "http://e.test/a?utm_source=x&gclid=1&q=": "http://e.test/a?q=",
        "http://e.test/a?q=a%20b&q=~*": "http://e.test/a?q=a+b&q=~%2A",
        "http://e.test/a?ref=1&ref_src=2&reference=3": "http://e.test/a?reference=3",
        "http://e.test/a?flag&x=1": "http://e.test/a?flag=&x=1",
    }
    assert one(spark, cases, urls.normalize_url) == list(cases.values())
    assert one(spark, ["http://e.test/?utm_x=1&a=2"], lambda u: urls.normalize_url(u, strip=False)) == ["http://e.test/?a=2&utm_x=1"]


def test_state_identity(spark):
    same = [
        "https://x.test/p?b=2&a=1", "https://x.test/p/?a=1&b=2", "https://x.test/p?a=1&b=2#frag", "https://x.test/p?a=1&utm_campaign=z&b=2&fbclid=9",
    ]
    assert len(set(one(spark, same, urls.norm_state_url))) == 1
    kept = ["https://x.test/w?oldid=1", "https://x.test/w?oldid=2", "https://x.test/w?page=1"]
    assert len(set(one(spark, kept, urls.norm_state_url))) == 3
    assert one(spark, ["https://X.test/"], urls.norm_state_url) == ["https://X.test"]
    assert one(spark, ["https://x.test/a"], urls.nav_state_key) == ["u::https://x.test/a"]


def test_light_and_hosts(spark):
    assert one(spark, ["x/#f", "x/", "x#f", None], urls.norm_light) == ["x/", "x", "x", ""]
    assert one(spark, ["https://u:p@WWW.a.b.test:80/x"], urls.host_key) == ["a.b.test"]
    assert one(spark, ["https://a.b.test/", "http://localhost/"], lambda u: urls.host_key(u, True)) == ["b.test", "localhost"]
    assert one(spark, ["https://a.test/", "https://a.test/s/t?q=1"], urls.section_key) == ["root", "s?q=1"]
    assert one(spark, ["https://a.test/", "https://a.test/s/t/u", "no url"], urls.url_path) == ["/", "/t/u", None]


def test_downloads_and_crawlable(spark):
    cases = {"https://a.test/f.PDF?x=1": True, "https://a.test/pdf": False, "blob:x": True, "data:,a": True, None: False, "https://a.test/?f=a.pdf": False}
    assert one(spark, cases, urls.is_direct_download) == list(cases.values())
    crawl = {"mailto:a@b": False, "#x": False, "/rel": False, "https://www.a.test/x": True, "https://b.test/": False, "JAVASCRIPT:1": False}
    assert one(spark, crawl, lambda u: urls.is_crawlable(u, F.lit("a.test"))) == list(crawl.values())


def test_resolve(spark):
    from urllib.parse import urljoin

    base = "https://h.test/a/b/c.html?q=1#top"
    hrefs = ["d", "./d", "../d", "../../d", "../../../d", "/d/./e/../f", "//o.test/x", "?z=2", "#frag", "https://o.test", "d/", "..", "", "d?x=/../y"]
    got = one(spark, hrefs, lambda u: urls.resolve(F.lit(base), u))
    # an empty href is the page itself, without its fragment
    assert got == [urljoin(base, h) if h else base.split("#")[0] for h in hrefs]
