from docketry.llm import url_filters as u
from tests.llm.conftest import key

URLS = [
    "http://a.org/x", "https://EXAMPLE.org/es/1", "https://x.example.org/en/123", "https://example.org/en/2", "http://b.com/fr/", "http://com/de/?q", "http://c.com/de",
    "http://notexample.org/es/", "http://org", "http://org#a/es/", "ftp://a.b.org?x=/es/", "no scheme.org/", "", None, "://", "http://a://b.org/es/", "http://a..org/", "http://user@a.org:80/", "http://a.org\n/x",
    "http://" + "a." * 200 + "org/" + "p" * 3000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, u.DEFAULT
    rest = url.split("://", 1)[1]
    n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else u.DEFAULT


def test_against_brute_force(spark):
    rows = [(i, x, "other") for i, x in enumerate([*URLS, URLS[0], URLS[1]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    expected = key((i, x, *brute(x)) for i, x, _ in rows)
    assert key(u.judge_urls(pages, u.rule_table(spark)).collect()) == expected


def test_shuffled_rules(spark, monkeypatch):
    monkeypatch.setattr(u, "MOST_BROADCAST", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert key(u.judge_urls(pages, u.rule_table(spark)).collect()) == key((i, x, *brute(x)) for i, x in enumerate(URLS))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(pages, u.rule_table(spark)).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    one = u.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), none).first()
    assert (one["rule"], one["verdict"]) == (None, "allow")
