import pytest

from stageloom.llm import queries, urls


def judged(spark, pages, outcomes=()):
    pages = spark.createDataFrame(list(pages), "page_id long, url string, host string")
    outcomes = spark.createDataFrame(list(outcomes), "url string, good int")
    return {r.page_id: r for r in urls.judge_urls(pages, outcomes, queries.URL_RULES).collect()}


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/x": ("example.net", "/EN/x", "net/", "block"),
        "http://other.net": ("other.net", "", None, "allow"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "ftp://sub.example.com/de/a://b": ("sub.example.com", "/de/a://b", "example.com/de/", "block"),
        "https://x.org/fr/?a": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://xorg/fr/": ("xorg", "/fr/", None, "allow"),
        "no scheme/path": ("", "", None, "allow"),
        "https://?x": ("", "", None, "allow"),
        "https://host#f/x": ("host", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    got = judged(spark, [(i, u, "clash") for i, u in enumerate(cases)])
    for i, (url, want) in enumerate(cases.items()):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == want, url


def test_bad_hosts_are_blocked_and_others_inherit(spark):
    pages = [(1, "http://bad.site.com/1", ""), (2, "http://good.site.com/", ""), (3, "http://new.site.com/", ""), (3, "http://new.site.com/", "")]
    outcomes = [("http://bad.site.com/1", 0)] * 60 + [("http://good.site.com/", 1)] * 60 + [("http://good.site.com/", None)]
    got = judged(spark, pages, outcomes)
    assert (got[1].verdict, got[2].verdict) == ("block", "allow")
    assert got[1].mean < got[3].mean < got[2].mean and got[3].n_labelled == 0
    assert got[2].n_labelled == 60


def test_shrinkage_by_hand(spark):
    """Two hosts of one domain: the level means follow (s * prior + good) / (s + n) with the fitted strengths."""
    urls_ = spark.createDataFrame([("http://a.x.com/",), ("http://b.x.com/",)], "url string")
    outcomes = spark.createDataFrame([("http://a.x.com/", 1)] * 8 + [("http://b.x.com/", 0)] * 4, "url string, good int")
    got = {r.host: r for r in urls.host_reputation(urls_, outcomes).collect()}
    overall = 9 / 14
    suffix = domain = None
    n, good = 12.0, 8.0
    suffix = (1000 * overall + good) / (1000 + n)
    domain = (1000 * suffix + good) / (1000 + n)
    p, groups = good / n, [(8.0, 8.0), (4.0, 0.0)]
    spread = sum(g * g / k for k, g in groups) - n * p * p
    noise = p * (1 - p)
    rho = (spread - noise) / (noise * (n - sum(k * k for k, _ in groups) / n - 1))
    strength = min(max(1 / rho - 1, 1), 1000)
    for host, (k, g) in zip(("a.x.com", "b.x.com"), groups, strict=True):
        assert got[host].mean == pytest.approx((strength * domain + g) / (strength + k))


def test_empty(spark):
    assert judged(spark, []) == {}


def test_main_path_is_native(spark, plan_of):
    pages = spark.createDataFrame([(1, "http://a.b/", "")], "page_id long, url string, host string")
    plan = plan_of(urls.judge_urls(pages, spark.createDataFrame([], "url string, good int"), queries.URL_RULES))
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow", "Cartesian"))


def test_domains_and_suffixes(spark):
    cases = {
        "a.b.co.uk": ("b.co.uk", "co.uk"),
        "b.co.uk:8080": ("b.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "x.notco.uk": ("notco.uk", "uk"),
        "a.b.s3.eu.cloud.com": ("b.s3.eu.cloud.com", "s3.eu.cloud.com"),
        "a.b.eu.cloud.com": ("b.eu.cloud.com", "eu.cloud.com"),
        "a.b.com:8080": ("b.com", "com"),
        "10.2.0.1": ("10.2.0.1", urls.ADDRESS),
        "10.9.0.1:80": ("10.9.0.1", urls.ADDRESS),
        "[::1]:80": ("[::1]", urls.ADDRESS),
        "host:1": ("host", "host"),
        "": ("", ""),
    }
    listed = ["co.uk", "EU.cloud.com", "s3.eu.cloud.com", "com"]
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = hosts.select("host", urls.registered_domain(hosts.host, listed), urls.host_suffix(hosts.host, listed)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_registrants_below_one_suffix_do_not_pool(spark):
    outcomes = [("http://a.bad.co.uk/", 0)] * 60 + [("http://b.bad.co.uk:81/", 0)] * 60 + [("http://www.good.co.uk/", 1)] * 60
    outcomes += [("http://10.1.0.1/", 0)] * 60
    new = ["http://new.bad.co.uk/", "http://new.good.co.uk/", "http://10.1.0.1:8080/", "http://10.2.0.1/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(new)], "page_id long, url string")
    outcomes = spark.createDataFrame(outcomes, "url string, good int")
    mean = [r["mean"] for r in urls.judge_urls(pages, outcomes, [], suffixes=queries.URL_SUFFIXES).orderBy("page_id").collect()]
    pooled = [r["mean"] for r in urls.judge_urls(pages, outcomes, []).orderBy("page_id").collect()]
    assert mean[0] < mean[1] and pooled[0] == pooled[1] and mean[2] < mean[3]
