import re
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from rastergrid.llm import urlrules as U
from rastergrid.llm.queries import HOST_RULES, LLM_QUERIES

URLS = [
    "http://a.Example.ORG/es/1", "https://example.org/en/12?x=1", "https://example.org/en/2#t", "http://x.com/fr/9", "http://x.com/de/9",
    "http://com/de/", "http://notcom/de/", "http://xcom/de/3", "http://org", "http://org?q=/", "http://org/", "no scheme/de", None, "",
    "://", "ftp://h.net#frag/x", "http://example.org.evil.net/es/1", "a://b://c.org/d", "http://u@B.com:80/de/", "http://x.com/de",
    "HTTP://X.COM/DE/1", "http://a.example.org/en/1", "http://ünï.Ä.org/ö?ü", "http://l\nine.org/a\nb?c", "http://x.net/" + "seg/" * 2000,
]


def brute_host(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fit = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in HOST_RULES
           if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "clash", "clash", "clash") for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, tokens string, verdict string")


def no_rules(spark):
    return U.mine(spark.createDataFrame([], "url string, bad boolean"))


def test_host_rules(spark):
    got = U.judge(frame(spark, URLS * 2), HOST_RULES, no_rules(spark)).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = brute_host((URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_tokens(spark):
    rows = frame(spark, ["HTTP://Www.a-1.com/En/123.html/x//?Page=2&ref=x&page=7#q", None, "x", "ü://"]).select(U.tokens_of(F.col("url")).alias("t"))
    assert [r.t for r in rows.collect()] == [
        ["s:http", "h:www", "h:a-#", "h:com", "p:en", "p:#.html", "p:x", "q:page", "q:ref"], [], [], ["s:ü"]]


def brute_rules(rows, need, confidence):
    """Every combination of tokens of every bad URL, and those that hold no other as sure."""
    sets = [(frozenset(t), bad) for t, bad in rows]
    found = {}
    for t, bad in sets:
        if bad:
            for x in chain.from_iterable(combinations(sorted(t), n) for n in range(1, len(t) + 1)):
                found[frozenset(x)] = 0
    for x in found:
        n, b = (sum(x <= t and (bad or every) for t, bad in sets) for every in (True, False))
        found[x] = (b / n, b) if b >= need and b / n >= confidence else None
    kept = {x: v for x, v in found.items() if v}
    return {x: v for x, v in kept.items() if not any(y < x and w[0] >= v[0] for y, w in kept.items())}


def planted(n=240):
    rows = []
    for i in range(n):
        host = ["spam", "news", "shop", "blog"][i % 4]
        path = ["de", "fr", "en"][i // 4 % 3]
        bad = host == "spam" and path != "en" and i % 5 != 0 or host == "shop" and path == "fr" or i % 29 == 0
        rows.append((f"http{'s' if i % 2 else ''}://{host}.net/{path}/{i}" + ("?ref=x" if i % 7 == 0 else ""), bad))
    return rows


def test_mined_rules_equal_brute_force(spark):
    rows = planted()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = labelled.select("bad", U.tokens_of(F.col("url")).alias("t")).collect()
    for confidence in (0.5, 0.75, 1.0):
        got = U.mine(labelled, least=5, confidence=confidence).collect()
        want = brute_rules([(r.t, r.bad) for r in tokens], 5, confidence)
        assert {frozenset(r["items"]): (pytest.approx(r.confidence), r.n_bad) for r in got} == want and want
        assert all(r.lead in r["items"] for r in got)


def test_mined_rules_block(spark):
    mined = U.mine(spark.createDataFrame(planted(), "url string, bad boolean"), least=5, confidence=0.7)
    urls = ["http://x.spam.net/de/5", "http://spam.net/en/5", "http://shop.net/fr/1", "https://blog.net/fr/1", "http://spam.com/de/1",
            "http://spam.com/fr/9"]
    got = {r.page_id: r for r in U.judge(frame(spark, urls), HOST_RULES, mined).collect()}
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert got[0].rule is None and got[0].pattern and got[0].confidence >= 0.5
    assert got[5].rule == "com/fr/" and got[5].pattern      # the host rule outranks the mined one


def test_long_urls_that_repeat(spark):
    """One URL with 300 tokens in a third of all rows."""
    url = "http://long.net/" + "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [(url, True)] * 100 + planted(200)
    mined = U.mine(spark.createDataFrame(rows, "url string, bad boolean"), least=20, confidence=0.9)
    got = U.judge(frame(spark, [url, "https://blog.net/en/1"]), [], mined).collect()
    assert {r.page_id: r.verdict for r in got} == {0: "block", 1: "allow"}


def test_labels(spark):
    pages = spark.createDataFrame([(0, "http://a.b/en/7.html"), (1, "http://a.b/en/8"), (2, "http://a.b/en/99999999999999999999"),
                                   (3, None), (4, "x"), (5, "http://a.b9/c/9?8")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, None, None), (9, 0, None), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.url: r.bad for r in U.labelled_pages(pages, labels).collect()}
    assert got == {"http://a.b/en/7.html": True, "http://a.b/en/8": False, "http://a.b9/c/9?8": True}


def test_empty(spark):
    assert no_rules(spark).count() == 0
    assert U.judge(frame(spark, URLS).limit(0), HOST_RULES, no_rules(spark)).count() == 0
    few = spark.createDataFrame([("http://a.b/c", None), (None, True), ("http://a.b/d", True)], "url string, bad boolean")
    assert U.mine(few).count() == 0 and U.mine(few, least=1).count() >= 1


def test_query_runs_no_python(spark, sf):
    out = LLM_QUERIES["op11_url_rules"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
