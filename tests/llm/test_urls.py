import pytest

from postlark.llm.urls import filter_urls

RULES = "VALUES ('org', '/', 'allow'), ('Example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('b.org', null, 'block'), (null, '/', 'block') AS r(host, path, verdict)"
URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/es/1?x=/en/1", "http://notexample.org/es/1", "http://example.org/en/12#top",
    "http://example.org", "http://example.org?/es/", "http://x.b.org", "http://b.org/", "no scheme example.org/es/", None, "", "://",
    "http://example.net/es/", "http://org/", "x://y://example.org/es/", "http://" + "a." * 3000 + "example.org/es/" + "p" * 50_000,
    "http://example.org/es", "http://exa\nmple.org/es/\n?", "http://example.org./es/", "http://ÀÉ.example.org/es/é",
]


def brute(url):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("b.org", "", "block")]
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_equals_brute_force_with_and_without_broadcast(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = [(i if i % 3 else None, u, "x") for i, u in enumerate(URLS * 2)]
        pages = spark.createDataFrame(rows, "page_id long, url string, host string")
        got = filter_urls(pages, spark.sql(f"SELECT * FROM {RULES}")).select("page_id", "url", "host", "path", "rule", "verdict").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, u, *brute(u)) for i, u, _ in rows), key=repr)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in filter_urls(pages, none, default="block").collect()] == [(1, "http://a.org/x", "a.org", "/x", None, "block")]
    assert filter_urls(pages.where("false"), spark.sql(f"SELECT * FROM {RULES}")).collect() == []
