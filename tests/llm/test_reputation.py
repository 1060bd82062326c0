"""op12 against plain Python: hosts, rules, and the model's numbers level by level."""

import math
import random
import re

from skarn.llm import reputation

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/EN/", "HTTP://x.net", "http://x.net/", "http://x.net?a/b", "ftp://Sub.EXAMPLE.com/de/1", "x://example.com/de", "http://org/fr/", "http://borg/fr/",
    "http://a.org/fr/#x", "http://a.org#/fr/", "://h/p", "a://b://c/d", "http://Ä.ORG/é\n/x", "http://10.0.0.1:80/p", "http://a.b.co.uk/en/", "http://" + "long." * 3000 + "com/" + "p" * 100_000, "http://net/", "http://example.net.org/en/",
]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)), m.group(2)) if m else ("", "")
    best = None
    for verdict, h, p in reputation.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://x.net/"), (3, "http://a.com/")]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in rows], "page_id long, url string, host string, rule string, n int")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, none).collect()), key=repr)
    want = [(i, h, p, b and b[0], b[1] if b else "allow") for i, u in rows for h, p, b in [plain(u)]]
    assert got == sorted(want, key=repr)
    assert reputation.judge(pages.limit(0), none).count() == 0


def parent(host):
    labels = re.sub(":[0-9]*$", "", host).split(".")
    if len(labels) < 2 or re.fullmatch("[0-9]*", labels[-1]):
        return host, ""
    k = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in reputation.SECOND else 1
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def model(counts):
    """Posterior mean and bound of each host, from (n, bad) by host."""
    def strength(groups):
        groups = [g for g in groups if g[0]]
        v = [m * (1 - m) for _, _, m in groups]
        s, w = sum(n * (b / n - m) ** 2 for n, b, m in groups), sum(x * (n - 1) for x, (n, _, _) in zip(v, groups))
        rho = (s - sum(v)) / w if groups and w else 0
        return min(1000, max(2, 1 / rho - 1)) if rho > 0 else 1000

    def level(key):
        out = {}
        for h, (n, b) in counts.items():
            x = out.setdefault(key(h), [0, 0])
            x[0] += n
            x[1] += b
        return out

    n, bad = (sum(c[i] for c in counts.values()) for i in (0, 1))
    prior, k = {None: (bad + 1) / (n + 2)}, 0
    for key, up in ((lambda h: parent(h)[1], lambda h: None), (lambda h: parent(h)[0], lambda h: parent(h)[1]), (lambda h: h, lambda h: parent(h)[0])):
        groups = level(key)
        above = {key(h): prior[up(h)] for h in counts}
        k = strength([(n, b, above[g]) for g, (n, b) in groups.items()])
        prior = {g: (k * above[g] + b) / (k + n) for g, (n, b) in groups.items()}
    return {h: (p, p - reputation.Z * math.sqrt(p * (1 - p) / (k + counts[h][0] + 1))) for h, p in prior.items()}


def test_reputation_of_hosts(spark):
    rng = random.Random(2)
    rate = {f"s{i}.{d}": r for d, r in (("good.com", 0.02), ("bad.com", 0.9), ("mixed.co.uk", 0.4), ("10.0.0.1:8", 0.5)) for i in range(12)}
    pages, outcomes, counts = [], [], {}
    for host, r in rate.items():
        for _ in range(rng.choice((1, 3, 40))):
            i = len(pages)
            pages.append((i, f"http://{host}/p{i}"))
            c = counts.setdefault(host, [0, 0])
            if rng.random() < 0.8:
                bad = rng.random() < r
                outcomes.append((i, bad))
                c[0] += 1
                c[1] += bad
    outcomes += [(outcomes[0][0], False), (None, True), (5, None), (10**9, True)]
    own = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    got = {r.host: (r.mean, r.bound, r.verdict) for r in reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), own).collect()}
    want = model(counts)
    assert got.keys() == want.keys()
    for h, (mean, bound) in want.items():
        assert abs(got[h][0] - mean) < 1e-9 and abs(got[h][1] - bound) < 1e-9
        assert got[h][2] == ("block" if bound > reputation.LIMIT else "allow")
    assert {h for h in got if got[h][2] == "block"} >= {h for h in rate if h.endswith("bad.com") and counts[h][0] > 20}
    assert all(got[h][2] == "allow" for h in rate if h.endswith("good.com"))


def test_many_rules_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xy/z"), (2, "http://q.c/")], "page_id long, url string")
    rules = [("allow", "b.c", "/x"), ("block", "c", "/xy/"), ("block", "c", "/xyz"), ("allow", "c", "/xy")] + [("block", f"h{i}.c", "/") for i in range(200)]
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.rule, r.verdict) for r in reputation.judge(pages, none, rules).collect()}
    assert got == {1: ("c/xy/", "block"), 2: (None, "allow")}


def test_no_python_in_the_plan(spark):
    plan = reputation.op12_urls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("== Physical Plan ==")[1]
