import pytest
from pyspark.sql import functions as F

from noticeflow.llm import urls


@pytest.fixture(scope="module")
def weights(spark):
    return urls.train(spark)


def judged(spark, weights, names):
    df = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(names)], "page_id long, url string, host string")
    return [r for r in urls.judge(df, weights).orderBy("page_id").collect()]


def test_parts_and_rules(spark, weights):
    cases = {
        "http://a.B.Net/x?q#f": ("a.b.net", "/x", "net/", "block"),
        "https://example.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://m.example.net/en": ("m.example.net", "/en", "net/", "block"),
        "https://www.example.com/de/7#x": ("www.example.com", "/de/7", "example.com/de/", "block"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "http://planet/x": ("planet", "/x", None, None),
        "http://x.net": ("x.net", "", None, None),
        "http://x.net?a://b/c": ("x.net", "", None, None),
        "x://É.NET/": ("É.net", "/", "net/", "block"),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    for r, (host, path, rule, verdict) in zip(judged(spark, weights, list(cases)), cases.values()):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_model_on_hosts_it_has_not_seen(spark, weights):
    bad = ["http://casino-royal.example.com/en/4", "https://cheapest-pills.example.org/de/9", "http://spam.test.com/a",
           "http://free-betting.example.com/x", "http://adult-videos.example.org/en/1"]
    good = ["http://gardening.example.com/en/4", "https://news-weekly.example.org/en/9", "http://thenation.example.com/x",
            "http://museum-of-science.example.org/en/1", "https://www.history-archive.example.com/es/3"]
    verdicts = [r.verdict for r in judged(spark, weights, bad + good)]
    assert verdicts == ["block"] * 5 + ["allow"] * 5


def test_long_and_repeated_urls_and_empty_table(spark, weights):
    long = "http://" + "ab." * 30_000 + "com/" + "x" * 50_000
    rows = judged(spark, weights, [long, long])
    assert rows[0].verdict == rows[1].verdict and len(rows[0].path) == 50_001
    assert judged(spark, weights, []) == []


def test_only_spark_expressions(spark, weights):
    plan = urls.judge(spark.range(3).select(F.lit("http://a.com/").alias("url")), weights)
    assert "Python" not in plan._jdf.queryExecution().toString()
