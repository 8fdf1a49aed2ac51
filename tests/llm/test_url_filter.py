"""URL filters: parts and rules against plain Python, the model by held-out accuracy."""

import random
import re

from pyspark.sql import functions as F

from factloom.llm import url_filter
from factloom.llm.queries import URL_RULES


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def frame(spark, urls):
    return spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, n int, host string")


def check(rows, urls):
    for r in rows:
        host, path = plain(urls[r.id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "://x", "a://b://c/d", "http://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/", "http://xexample.com/en/", "http://É.net/es/a\nb",
            "http://a.net/fr/?q=1&r=2", "http://net/fr/", "http://a.net/fr", "http://h?x/y", "http://h#x", "http://com./", "http://k.com/" + "a1/" * 50000, "http://u@example.com:80/en/"]
    urls += urls
    check(url_filter.judge(frame(spark, urls), URL_RULES).collect(), urls)
    assert url_filter.judge(frame(spark, []), URL_RULES).count() == 0
    only = url_filter.judge(frame(spark, ["http://a.org/x", None]), URL_RULES).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    rows = url_filter.judge(pages, URL_RULES).collect()
    assert len(rows) == len(urls)
    check(rows, urls)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    def url(bad):
        if bad:
            return f"http://{word(12)}{rng.randrange(10**5)}.{rng.choice(['xyz', 'top', 'com'])}/{word(3)}?{'&'.join(f'{word(2)}={rng.randrange(10**6)}' for _ in range(rng.randrange(2, 6)))}"
        return f"https://{rng.choice(['', 'www.'])}{word(6)}.{rng.choice(['com', 'org'])}/{'/'.join(word(6) for _ in range(rng.randrange(1, 4)))}"

    rows = [(url(i % 2), float(i % 2)) for i in range(1200)]
    table = spark.createDataFrame(rows, "url string, label double")
    host, path = url_filter.parts(F.col("url"))
    model = url_filter.UrlModel(table.limit(800))
    test = model.score(spark.createDataFrame(rows[800:], "url string, label double").withColumns({"host": host, "path": path})).collect()
    assert sum((r.score > 0.5) == (r.label > 0.5) for r in test) >= 0.95 * len(test)


def test_a_rare_label_and_a_frequent_url(spark):
    rows = [("http://hot.org/a", 0.0)] * 3000 + [(f"http://h{i}.org/{i}", 0.0) for i in range(2000)] + [(f"http://b{i}.xyz/?p={i}", 1.0) for i in range(12)]
    host, path = url_filter.parts(F.col("url"))
    model = url_filter.UrlModel(spark.createDataFrame(rows + [("http://none.xyz/", None)], "url string, label double"), sample=200)
    assert model.only is None
    assert {r.suffix_1: (r.blocked, r.n) for r in model.suffixes[0].collect()} == {"org": (0.0, 2001), "xyz": (12.0, 12)}
    asked = spark.createDataFrame([("http://b12.xyz/?p=12",), ("http://h2345.org/2345",), ("http://h77.org/77",)], "url string").withColumns({"host": host, "path": path})
    assert [r.score > 0.5 for r in model.score(asked).orderBy("url").collect()] == [True, False, False]
