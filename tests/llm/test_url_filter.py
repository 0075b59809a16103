import numpy as np

from cellgrad.llm import url_filter as U


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")


def test_hosts_paths_and_rules(spark):
    urls = {
        "HTTP://WWW.Example.COM:80/en/x?y#z": ("www.example.com:80", "/en/x", None),
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/"),
        "https://example.com/en/?q": ("example.com", "/en/", "example.com/en/"),
        "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/"),
        "https://b.net/es/2": ("b.net", "/es/2", "net/es/"),
        "https://net/fr/2#t": ("net", "/fr/2", "net/fr/"),
        "https://b.net/es": ("b.net", "/es", None),
        "x://y.com": ("y.com", "", None),
        "x://y.com?u://z": ("y.com", "", None),
        "a b://H\nx/p q": ("h\nx", "/p q", None),
        "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None), "://": ("", "", None),
    }
    df = pages_of(spark, [(k, u, None, None, None) for k, u in enumerate(urls)])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in U.judged(df).collect()}
    assert got == {k: v for k, v in enumerate(urls.values())}


def plain_rank(edges, seeds, damping, steps):
    """edges: {(src, dst): weight}; seeds: {host: share}."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in edges.items():
        m[at[b], at[a]] = w
    total = m.sum(axis=0)
    m = m / np.where(total > 0, total, 1)
    s = np.array([seeds.get(h, 0.0) for h in hosts]) * (1 - damping)
    r = s
    for _ in range(steps):
        r = s + damping * m @ r
    return {h: r[at[h]] / (1 - damping) for h in hosts}


def test_scores_equal_dense_iteration(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts) + '<a href=/local><img src="//cdn.org/i">'
    rows = [(1, "http://good.com/", link("friend.org", "friend.org", "a.friend.org"), None, None),
            (2, "http://good.com/2", link("friend.org"), None, None),
            (3, "http://spam.net/es/", None, None, None),
            (4, "http://farm.org/", link("spam.net"), None, None),
            (5, "http://farm2.org/", link("spam.net", "good.com"), None, None),
            (6, "http://lone.org/", None, None, None), (7, None, link("spam.net"), None, None)]
    pages = U.judged(pages_of(spark, rows))
    edges = {(r["src"], r["dst"]): r["weight"] for r in U.host_edges(pages).collect()}
    assert edges[("good.com", "friend.org")] == 2 and edges[("a.friend.org", "friend.org")] == 1
    assert edges[("farm.org", "cdn.org")] == 1 and ("lone.org", "lone.org") not in edges
    got = {r["host"]: (r["trust"], r["distrust"]) for r in U.host_scores(pages).collect()}
    trust = plain_rank(edges, {"good.com": 1.0}, U.DAMPING, 300)
    distrust = plain_rank({(b, a): w for (a, b), w in edges.items()}, {"spam.net": 1.0}, U.DAMPING, 300)
    for h, (t, d) in got.items():
        assert abs(t - trust[h]) <= U.TOLERANCE and abs(d - distrust[h]) <= U.TOLERANCE
    verdicts = {r["page_id"]: r["verdict"] for r in U.url_filter(pages_of(spark, rows)).collect()}
    assert verdicts[3] == "block" and verdicts[1] == "allow" and verdicts[7] == "allow" and verdicts[6] == "allow"
    for margin in (0.1, 0.3, 0.5):
        verdicts = {r["page_id"]: r["verdict"] for r in U.url_filter(pages_of(spark, rows), margin=margin).collect()}
        for page, host in ((4, "farm.org"), (5, "farm2.org"), (6, "lone.org")):
            bad = distrust.get(host, 0) - trust.get(host, 0) > margin
            assert verdicts[page] == ("block" if bad else "allow")
        assert verdicts[4] == ("block" if margin < 0.4 else "allow")


def test_empty_and_clashing_columns(spark):
    df = pages_of(spark, [(1, "http://a.org/", None, "v", "h")])
    got = U.url_filter(df)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    assert U.url_filter(df.where("false")).collect() == []


def test_verdicts_equal_the_solved_system(spark):
    # A chain to spam, longer than any fixed number of rounds, with host ties.
    page = lambda k, h, to: (k, f"http://{h}/", f'<a href="https://{to}/">', None, None)
    rows = [(0, "http://spam.net/es/", None, None, None), page(1, "h1.org", "spam.net")]
    rows += [page(k, f"h{k}.org", f"h{k - 1}.org") for k in range(2, 16)]
    rows += [page(20 + k, f"s{k}.farm.org", "h3.org") for k in range(4)] + [page(30, "farm.org", "spam.net")]
    pages = U.judged(pages_of(spark, rows))
    edges = {(r["src"], r["dst"]): r["weight"] for r in U.host_edges(pages).collect()}
    hosts = sorted({h for e in edges for h in e})
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in edges.items():
        m[at[a], at[b]] = w  # reversed: distrust
    total = m.sum(axis=0)
    seed = np.eye(len(hosts))[at["spam.net"]]
    solved = np.linalg.solve(np.eye(len(hosts)) - 0.6 * m / np.where(total > 0, total, 1), seed)
    got = {r["host"]: r["distrust"] for r in U.host_scores(pages, damping=0.6).collect()}
    assert all(abs(got.get(h, 0.0) - solved[at[h]]) <= U.TOLERANCE for h in hosts)
    margin = float(solved[at["h11.org"]]) * 0.9
    verdicts = {r["host"]: r["verdict"] for r in U.url_filter(
        pages_of(spark, rows), margin=margin, damping=0.6).collect()}
    assert verdicts == {h: "block" if h == "spam.net" or solved[at[h]] > margin else "allow" for h in verdicts}
    assert verdicts["h11.org"] == "block" and verdicts["h15.org"] == "allow"
