"""URL verdicts and walks over the host graph against plain Python."""

import random
from collections import Counter

from llm import url_filter as U

rng = random.Random(9)


def test_urls(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    pages = [
        (1, "http://A.example.org/es/1?q#f", ""), (2, "https://x.org/", link("good.net") + link("Spam.net")), (3, "http://good.net", "<a href='/local'>"), (4, "http://farm.net/p", link("bad.com") * 3),
        (5, "http://bad.com/de/1", None), (6, "http://bad.com/other", ""), (7, None, link("bad.com")), (8, "no scheme", ""), (9, "http://example.org/en/12", ""), (10, "http://example.org/en/2", ""),
        (11, "http://notexample.org/es/", ""), (12, "http://fr.com/fr/1", link("mixed.net")), (13, "http://mixed.net/a://b", link("bad.com") + link("x.org")), (5, "http://bad.com/de/1", None), (14, "http://org?x/", ""),
        (15, "HTTP://EXAMPLE.ORG/ES/", "<IMG SRC=//User@Other.net/>"), (16, "http:///nohost", ""),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_filter(df).collect() if r.page_id not in (13,))
    rule = {p: (r, v) for p, _, _, r, v in got}
    assert rule[1] == ("example.org/es/", "block") and rule[9] == ("example.org/en/1", "block") and rule[10] == ("org/", "allow") and rule[11] == ("org/", "allow")
    assert rule[5] == ("com/de/", "block") and rule[12] == ("com/fr/", "allow") and rule[15] == ("org/", "allow")
    assert rule[3] == (None, "allow") and rule[4] == (None, "block") and rule[6] == (None, "block") and rule[7] == rule[8] == rule[16] == (None, "allow") and rule[14] == (None, "allow")
    hosts = {p: (h, q) for p, h, q, _, _ in got}
    assert hosts[1] == ("a.example.org", "/es/1") and hosts[3] == ("good.net", "") and hosts[7] == ("", "") and hosts[14] == ("org", "") and hosts[16] == ("", "/nohost")
    assert U.url_filter(df.limit(0)).count() == 0


def test_walk(spark):
    """Scores of a few hosts against the plain iteration."""
    edges = [(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}", rng.randrange(1, 5)) for _ in range(40)]
    edges = [(a, b, n) for (a, b), n in {(a, b): n for a, b, n in edges if a != b}.items()]
    seeds = [("h0", 3.0, 0.0), ("h1", 1.0, 2.0)]
    got = {(r.walk, r.host): r.score for r in U.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    for walk, start, steps in (("t", {"h0": 3.0, "h1": 1.0}, edges), ("d", {"h1": 2.0}, [(b, a, n) for a, b, n in edges])):
        out = Counter()
        for a, _, n in steps:
            out[a] += n
        now = dict(start)
        for _ in range(200):
            new = Counter({h: s * 0.15 for h, s in start.items()})
            for a, b, n in steps:
                new[b] += 0.85 * now.get(a, 0) * n / out[a]
            now = new
        assert all(abs(got.get((walk, h), 0) - s) < 2e-3 for h, s in now.items())
