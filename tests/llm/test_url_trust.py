import numpy as np
from pyspark.sql import functions as F

from loomwork.llm import queries
from loomwork.llm import url_trust as ut

RULES = queries.URL_RULES


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "verdict", "kind", "mass"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_host_path_and_longest_rule(spark):
    cases = [
        ("HTTP://A.Example.COM/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", False),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", True),
        ("https://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", True),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", True),
        ("http://b.net/fr/", "b.net", "/fr/", "net/fr/", False),
        ("http://b.net/en/", "b.net", "/en/", None, None),
        ("http://com", "com", "", None, None),
        ("http://a.com?x=/", "a.com", "", None, None),
        ("x://y://z/", "y:", "//z/", None, None),
        ("mailto:a", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("a\nb://ÄB.NET/es/\n", "Äb.net", "/es/\n", "net/es/", False),
    ]
    found = ut.with_rules(pages(spark, [(k, c[0], None) for k, c in enumerate(cases)]), RULES).orderBy("page_id").collect()
    for row, case in zip(found, cases, strict=True):
        assert (row.host, row.path, row.rule, row.allowed) == case[1:]


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">' for h in hosts)


def test_propagation_is_the_power_iteration(spark):
    hosts = ["a.com", "b.org", "c.org", "d.net", "e.org", "f.org"]
    rows = [(0, "http://a.com/", link("b.org", "b.org", "a.com")), (1, "http://b.org/", link("c.org")), (2, "http://d.net/es/", link("c.org")), (3, "http://e.org/", link("d.net", "b.org")), (4, "http://f.org/", None), (5, "http://e.org/2", link("d.net"))]
    df = pages(spark, rows)
    links = {(r.src, r.dst): r.links for r in ut.host_links(df).collect()}
    assert links == {("a.com", "b.org"): 1, ("b.org", "c.org"): 1, ("d.net", "c.org"): 1, ("e.org", "d.net"): 2, ("e.org", "b.org"): 1}
    seeds = [("trust", "a.com", 1.0), ("distrust", "d.net", 1.0)]
    got = {(r.kind, r.host): r.mass for r in ut.spread(spark.createDataFrame(seeds, "kind string, host string, mass double"), ut.host_links(df)).collect()}
    for kind, seed in (("trust", "a.com"), ("distrust", "d.net")):
        w = np.zeros((6, 6))
        for (s, d), n in links.items():
            a, b = (s, d) if kind == "trust" else (d, s)
            w[hosts.index(a), hosts.index(b)] += n
        out = w.sum(1, keepdims=True)
        w = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
        start = np.array([float(h == seed) for h in hosts])
        p = start.copy()
        for _ in range(ut.ROUNDS):
            p = (1 - ut.DAMPING) * start + ut.DAMPING * (p @ w + p[out[:, 0] == 0].sum() * start)
        for h, x in zip(hosts, p, strict=True):
            assert abs(got.get((kind, h), 0.0) - x) < 1e-9


def test_verdicts_and_odd_rows(spark):
    rows = [(0, "http://good.com/", link("friend.org")), (1, "http://bad.net/es/", None), (2, "http://near.org/", link("bad.net")), (3, "http://friend.org/", ""), (4, "http://alone.org/", None), (5, None, link("bad.net")), (6, "http://bad.net/en/", None), (6, "http://bad.net/en/", None), (None, "http://near.org/2", link("bad.net"))]
    found = ut.judged(pages(spark, rows), RULES).collect()
    assert len(found) == len(rows)
    verdict = {r.page_id: (r.rule, r.verdict) for r in found}
    assert verdict[0] == ("com/", "allow") and verdict[1] == ("net/es/", "block")
    assert verdict[2] == (None, "block") and verdict[6] == (None, "block") and verdict[None] == (None, "block")
    assert verdict[3] == verdict[4] == verdict[5] == (None, "allow")


def test_empty_table(spark):
    assert ut.judged(pages(spark, [(1, "http://a.com/", "")]).where("page_id < 0"), RULES).collect() == []


def test_whole_operator_by_brute_force(spark):
    """A generated graph with hubs, cycles, dangling hosts and hosts out of reach."""
    rng = np.random.default_rng(4)
    hosts = [f"h{k}.{'com' if k % 7 == 0 else 'net' if k % 5 == 0 else 'org'}" for k in range(90)]
    rows = []
    for k in range(400):
        src = hosts[int(90 * rng.random() ** 2)]
        to = [] if int(src[1:].split(".")[0]) % 4 == 3 else [hosts[int(90 * rng.random() ** 3)] for _ in range(rng.integers(0, 4))]
        rows.append((k, f"http://{src}/{('es', 'fr', 'en')[k % 3]}/p{k}", link(*to, "unseen.example") if k % 50 == 0 else link(*to)))
    judged = {r.page_id: r for r in ut.judged(pages(spark, rows), RULES).collect()}

    def rule(host, path):
        fits = [r for r in RULES if (host == r.text.split("/")[0] or host.endswith("." + r.text.split("/")[0])) and path.startswith("/" + r.text.split("/", 1)[1])]
        return max(fits, key=lambda r: len(r.text), default=None)

    names = [*hosts, "unseen.example"]
    at = {h: i for i, h in enumerate(names)}
    w, pages_of, seeds = np.zeros((91, 91)), np.zeros(91), np.zeros((2, 91))
    split = {k: (u.split("/")[2], "/" + u.split("/", 3)[3]) for k, u, _ in rows}
    for k, _, html in rows:
        host, path = split[k]
        pages_of[at[host]] += 1
        if r := rule(host, path):
            seeds[0 if r.allow else 1, at[host]] += 1
        for to in {x.split("/")[2] for x in html.split('"') if "//" in x} - {host}:
            w[at[host], at[to]] += 1
    mass = []
    for start, links in zip(seeds, (w, w.T), strict=True):
        out = links.sum(1, keepdims=True)
        step = np.divide(links, out, out=np.zeros_like(links), where=out > 0)
        p = start.copy()
        for _ in range(ut.ROUNDS):
            p = (1 - ut.DAMPING) * start + ut.DAMPING * (p @ step + p[out[:, 0] == 0].sum() * start / start.sum())
        mass.append(p)
    bad = (mass[1] >= ut.DISTRUST_SHARE * (mass[0] + mass[1])) & (mass[1] >= ut.DISTRUST_PER_PAGE * pages_of)
    verdicts = []
    for k, (host, path) in split.items():
        r, got = rule(host, path), judged[k]
        assert abs(got.trust - mass[0][at[host]]) < 1e-6 and abs(got.distrust - mass[1][at[host]]) < 1e-6
        allow = r.allow if r else not bad[at[host]]
        assert (got.rule, got.verdict) == (r and r.text, "allow" if allow else "block")
        verdicts.append((r is None, allow))
    assert len(set(verdicts)) == 4
