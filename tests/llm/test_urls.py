"""Rules, aliases and the precedence of allow."""

from foliant.llm.urls import filter_urls

RULES = [("allow", "org/"), ("block", "bad.org/x/"), ("block", "spam.com/"), ("allow", "spam.com/ok/")]


def judged(spark, rows, redirects=None):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects else None
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, RULES, redirects=more).collect()}


def test_rules(spark):
    rows = [(1, "http://A.Bad.ORG/x/1?q#f", ""), (2, "https://bad.org/y", None), (3, "nothing", ""), (4, None, ""), (5, "http://notspam.com/a", ""), (6, "x://spam.com", ""), (7, "http://spam.com/ok/1", "")]
    assert judged(spark, rows) == {
        1: ("a.bad.org", "/x/1", "bad.org/x/", "block"),
        2: ("bad.org", "/y", "org/", "allow"),
        3: ("", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("notspam.com", "/a", None, "allow"),
        6: ("spam.com", "", None, "allow"),
        7: ("spam.com", "/ok/1", "spam.com/ok/", "allow"),
    }


def test_aliases_of_blocked_pages_are_blocked(spark):
    rows = [
        (1, "http://a.net/1", '<link rel="canonical" href="http://b.net/2">'),
        (2, "https://b.net/2#top", '<meta http-equiv=refresh content="0; url=/3">'),
        (3, "http://b.net/3", '<link href="https://spam.com/z" rel=canonical>'),
        (4, "http://c.net/", '<LINK REL=\'canonical\' HREF="//d.net">'),
        (5, "http://d.net", ""),
    ]
    found = judged(spark, rows)
    assert [found[i][3] for i in range(1, 6)] == ["block", "block", "block", "allow", "allow"]


def test_allow_takes_precedence(spark):
    rows = [(1, "http://a.net/1", '<link rel="canonical" href="http://spam.com/z">'), (2, "http://spam.com/z", '<link rel="canonical" href="http://good.org/">'), (3, "http://good.org/", "")]
    assert {k: v[3] for k, v in judged(spark, rows).items()} == {1: "allow", 2: "block", 3: "allow"}


def test_redirect_log_and_repeated_rows(spark):
    rows = [(1, "http://a.net/1", ""), (1, "http://a.net/1", ""), (2, "http://b.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.net/1", "http://spam.com/q"), (None, "x"), ("http://b.net/", "")], "from_url string, to_url string")
    out = filter_urls(df, RULES, redirects=log).collect()
    assert sorted((r.page_id, r.verdict) for r in out) == [(1, "block"), (1, "block"), (2, "allow")]


def test_allow_wins_between_equal_rules(spark):
    df = spark.createDataFrame([(1, "http://x.com/a", None), (2, "http://y.x.com/b", "h")], "page_id long, url string, html string")
    for order in (1, -1):
        out = filter_urls(df, [("block", "x.com/"), ("allow", "x.com/")][::order]).collect()
        assert [(r.rule, r.verdict) for r in out] == [("x.com/", "allow")] * 2


def test_long_urls_and_ties(spark):
    rows = [(1, "http://a.net/" + "p" * 100_000, "<p>" * 100_000 + '<link rel=canonical href="//spam.com/1">')] * 2
    assert [r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()] == ["block", "block"]


def test_many_redirects(spark):
    """Aliases over a table as large as the given ones, beside a search over all edges."""
    import random

    r = random.Random(5)
    urls = [f"http://{r.choice(['a.net', 'b.org', 'bad.org', 'c.com', 'spam.com', 'd.io'])}/{r.choice(['x', 'y', 'ok'])}/{i}" for i in range(3000)]
    log = [(r.choice(urls), r.choice(urls)) for _ in range(1500)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {x.url: (x.rule, x.verdict) for x in filter_urls(pages, RULES, redirects=spark.createDataFrame(log, "from_url string, to_url string")).collect()}
    near = {u: set() for u in urls}
    for a, b in log:
        near[a].add(b)
        near[b].add(a)
    seen, verdict = set(), {}
    for u in urls:
        if u not in seen:
            group, todo = {u}, [u]
            while todo:
                for v in near[todo.pop()] - group:
                    group.add(v)
                    todo.append(v)
            seen |= group
            said = {got[v][1] for v in group if got[v][0]}
            verdict |= dict.fromkeys(group, "block" if said == {"block"} else "allow")
    assert all(v == (got[u][1] if got[u][0] else verdict[u]) for u, (_, v) in got.items())
    assert sum(v == "block" and not rule for rule, v in got.values()) > 20


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string, verdict int"), RULES).count() == 0
