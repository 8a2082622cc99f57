from text_helpers import SMALL, docs, none, odd, texts  # noqa: F401 (fixtures)

from tidemark.llm import queries, url_rules


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def ruled(host, path):
    fits = [r for r in url_rules.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return best and best[1] + best[2], best and best[0]


def test_rules_of_all_pages(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.catalog.queries["op10_url_rules"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parts(pages[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict


def test_decisions_reach_aliases(spark):
    canon = '<HTML><link href="{}" rel="canonical">'
    jump = "<meta http-equiv=refresh content='0; URL={}'>"
    rows = [
        (1, "http://a.net/es/1", None), (2, "http://b.org/x", canon.format("https://A.net/es/1?utm_source=q#t")),
        (3, "http://c.org/y", jump.format("http://b.org/x/")),  # two steps from a blocked page
        (4, "http://d.org/z", canon.format("http://d.com/ok")), (5, "http://d.com/ok", ""),  # allowed
        (6, "http://e.org/m", canon.format("http://e.net/fr/1")), (7, "http://e.net/fr/1", canon.format("http://e.com/a")),
        (8, "http://e.com/a", None),  # a group with both: the allowed page goes first
        (9, "http://lone.org/", canon.format("/")), (10, None, None), (11, "no scheme", canon.format("http://a.net/es/1")),
        (12, "https://b.org/x?ref=mail", None), (13, "http://B.ORG/x#f", None), (13, "http://B.ORG/x#f", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got[1] == ("net/es/", "block") and got[7] == ("net/fr/", "block") and got[8] == ("com/", "allow")
    assert {i for i, r in got.items() if r[1] == "block"} == {1, 2, 3, 7, 12, 13}
    assert url_rules.judge(df).count() == len(rows) and url_rules.judge(df.where("page_id < 0")).count() == 0


def test_decisions_reach_relative_aliases(spark):
    canon, blocked = '<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; URL=http://a.net/es/1'>"
    rows = [
        (1, "http://h.org/d/page.html", blocked), (2, "http://h.org/d/x?q=1#f", canon.format("page.html")),
        (3, "http://h.org/d/e/y", canon.format("../page.html")), (4, "http://h.org/d/page.html?id=2&l=3", blocked),
        (5, "http://h.org/d/page.html?z=1", canon.format("?id=2&amp;l=3")), (6, "http://h.org/z", '<base href="/d/e/">' + canon.format("./../p&#97;ge&#x2E;html")),
        (7, "http://h.org", canon.format("d/page.html")), (8, "http://h.org/k/v", canon.format("page.html")),
        (9, "http://h.org/k/w", canon.format("mailto:x@a.net")), (10, "no scheme", canon.format("page.html")),
        (11, "http://h.org/k/u", '<base href="http://h.org/d/f?x">' + canon.format("page.html")), (12, "http://h.org/k/../d/page.html", None),
        (13, "http://h.org/k/t", canon.format("&amp;#47;d&#47;page.html")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(df.union(spark.createDataFrame([(0, "http://a.net/es/1", None)], df.schema))).collect()}
    assert {i for i, v in got.items() if v == "block"} == {0, 1, 2, 3, 4, 5, 6, 7, 11, 12}
