from pyspark.sql import functions as F

from terrastrata.llm import url_filters
from terrastrata.llm.queries import LISTED_DOMAINS, URL_RULES

URLS = [
    "https://www.example.com/en/1", "http://a.example.com/en/", "http://example.com/en", "https://x.com/", "https://x.com", "https://x.com?q=/en/", "HTTP://A.Net/es/x#y", "http://net/fr/", "http://knet/fr/",
    "https://m.casino-win.example.org/de/1", "https://casino-win.example.org.evil.org/", "spam-farm.example.org/x", "http://SPAM-FARM.example.org?x", None, "", "://", "://host", "http:///path", "a://b://c/d", "http://x.net/de/?a=://y.com/", "http://Ünï.example.com/EN/", "http://x.com/a\nb?c",
]


def brute(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = []
    for kind, rule in URL_RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, kind))
    rule = max(fits)[1] if fits else None
    hit = any(host == d or host.endswith("." + d) for d in listed)
    return host, path, rule, max(fits)[2] if fits else "block" if hit else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "html", "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, host string, hit string")


def listing(spark, domains):
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def test_urls(spark):
    got = {r[0]: tuple(r[1:]) for r in url_filters.judge(pages(spark, URLS), listing(spark, LISTED_DOMAINS), URL_RULES).collect()}
    assert [got[k] for k in range(len(URLS))] == [brute(u, LISTED_DOMAINS) for u in URLS]


def test_membership_is_exact_over_the_universe(spark):
    universe = [f"h{k}.example.org" for k in range(4000)]
    listed = set(universe[::7])
    frames = [spark.createDataFrame([(k,) for k in some], "key string") for some in (sorted(listed), universe)]
    levels = url_filters.cascade(*frames)
    assert len(levels) > 1
    assert url_filters.listed(universe, levels).tolist() == [k in listed for k in universe]


def test_shards_give_the_same(spark):
    urls = [f"http://s{k % 300}.site.org/x" for k in range(600)]
    domains = [f"s{k}.site.org" for k in range(0, 300, 3)]
    one, many = (url_filters.judge(pages(spark, urls), listing(spark, domains), [], max_bytes=b).orderBy("page_id").collect() for b in (1 << 20, 40))
    assert one == many and sum(r["verdict"] == "block" for r in one) == 200


def test_empty_list_and_empty_table(spark):
    assert {r["verdict"] for r in url_filters.judge(pages(spark, ["http://a.b/"]), listing(spark, []), []).collect()} == {"allow"}
    assert url_filters.judge(pages(spark, URLS).limit(0), listing(spark, ["x.y", None, ""]), URL_RULES).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = pages(spark, ["http://x.y/"]).withColumn("page_id", F.lit(None).cast("long"))
    got = url_filters.judge(rows.unionByName(rows), listing(spark, ["X.y"]), []).collect()
    assert [(r["page_id"], r["verdict"]) for r in got] == [(None, "block")] * 2


def test_very_long_urls(spark):
    """Hosts of very many labels and paths of a million characters: judged like others, without a table of all parent domains of such a host."""
    many = "a." * 200_000
    urls = [f"http://{many}spam-farm.example.org/" + "p/" * 500_000, f"http://{many}example.com/en/" + "x" * 1_000_000, "http://" + "h" * 1_000_000, "x" * 1_000_000 + "://net/es/", "http://casino-win.example.org"] * 2
    got = sorted(url_filters.judge(pages(spark, urls), listing(spark, LISTED_DOMAINS), URL_RULES).collect())
    assert [tuple(r)[1:] for r in got] == [brute(u, LISTED_DOMAINS) for u in urls]


def test_long_listed_domains_are_found(spark):
    listed = ["com", "deep.er.and.deeper.example.net", "x"]
    urls = ["http://deep.er.and.deeper.example.net/", "http://one.more.deep.er.and.deeper.example.net", "http://er.and.deeper.example.net", "http://a.com.", "http://x", "http://y.x", "http://x.y"]
    got = sorted(url_filters.judge(pages(spark, urls), listing(spark, listed), []).collect())
    assert [r["verdict"] for r in got] == ["block", "block", "allow", "allow", "block", "block", "allow"]
