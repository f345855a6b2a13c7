import re

import numpy as np

from quire.llm import queries, url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    best = None
    for text, says in queries.RULES:
        of, _, start = text.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best or (None, None)


def test_query_by_brute_force(spark, medium):
    expected = brute([(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{medium}/pages.parquet").collect()])
    rows = queries.op4_url_filters(spark, medium).collect()
    assert len(rows) == len(expected)
    for row in rows:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == expected[row["page_id"]][:4]


def hosts_linked(url, html):
    """Hosts that a page links to, by plain string work."""
    own, _ = split(url)
    out = []
    for m in re.finditer(r"""(?is)\bhref\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s>]+))""", html or ""):
        link = next(g for g in m.groups() if g is not None).strip()
        if link.startswith("//"):
            link = "x:" + link
        if re.match("[A-Za-z][A-Za-z0-9+.-]*://", link):
            out.append(split(link)[0])
        elif link and link[0] != "#" and not re.match("[A-Za-z][A-Za-z0-9+.-]*:", link):
            out.append(own)
    return [h for h in out if h]


def brute(pages):
    """{page: (host, path, rule, verdict)} with scores by solving the linear equations."""
    placed = {i: split(url) for i, url, _ in pages}
    ruled = {i: rule_of(*hp) for i, hp in placed.items()}
    hosts = sorted({h for h, _ in placed.values() if h} | {d for _, u, h in pages if split(u)[0] for d in hosts_linked(u, h)})
    at = {h: k for k, h in enumerate(hosts)}
    a = np.zeros((len(hosts), len(hosts)))
    for _, url, html in pages:
        if split(url)[0]:
            for d in hosts_linked(url, html):
                a[at[split(url)[0]], at[d]] += 1
    share = lambda m: m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    solve = lambda m, seed: np.linalg.solve(np.eye(len(hosts)) - url_filter.DAMPING * share(m).T, seed)
    score = {}
    for way, says, m in (("trust", "allow", a), ("distrust", "block", a.T)):
        mass = np.zeros(len(hosts))
        for h in hosts:
            own = [ruled[i][1] for i, (host, _) in placed.items() if host == h]
            mass[at[h]] = own.count(says) / len(own) if own else 0
        score[way] = solve(m, mass), solve(m, (mass > 0) * 1.0)
    out = {}
    for i, (host, path) in placed.items():
        rule, says = ruled[i]
        trust, distrust = (score[w][0][at[host]] if host else 0.0 for w in ("trust", "distrust"))
        full = max(score[w][1][at[host]] for w in ("trust", "distrust")) if host else 0.0
        out[i] = (host, path, rule, says or ("block" if distrust - trust > 0.5 * full + 1e-3 else "allow"), trust, distrust)
    return out


PAGES = "page_id long, url string, html string, host string, src string"
LINKS = [
    (1, "https://good.com/a", '<a href="http://mid.org/x">m</a><a href="//MID.org/y">m</a><a href=\'http://odd.org\'>o</a><a href="/own">'),
    (2, "http://mid.org/z", "<a href='https://odd.org/p'><a href='more.html'><a href=../up><a href='#part'><a href='mailto:a@b.org'>"),
    (3, "http://bad.net/es/1", "<a href=http://worse.org/><a href = \"?q\">"),
    (4, "http://worse.org/", "<a href='http://bad.net/es/q'>x</a>"),
    (5, "http://odd.org/", None),
    (6, None, "<a href='http://bad.net/'>"),
    (7, "no scheme", ""),
    (8, "HTTP://GOOD.COM?q#f", None),
    (9, "http://sub.www.example.com/en/x", "<a href='/'>"),
]


def pages(spark, rows=LINKS):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], PAGES)


def test_propagation_by_linear_equations(spark):
    found = {r["page_id"]: r for r in url_filter.judge(pages(spark), queries.RULES).collect()}
    expected = brute(LINKS)
    assert found.keys() == expected.keys()
    for i, (host, path, rule, verdict, trust, distrust) in expected.items():
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)
        assert abs(r["trust"] - trust) < 2e-3 and abs(r["distrust"] - distrust) < 2e-3
    assert found[3]["verdict"] == "block" and found[4]["verdict"] == "block" and found[4]["rule"] is None and found[5]["verdict"] == "allow"
    assert found[9]["rule"] == "www.example.com/en/" and found[8]["path"] == ""


def test_long_lists_of_rules(spark):
    rules = [(f"h{i}.org/", "block" if i % 2 else "allow") for i in range(3000)]
    rows = [(i, f"http://a.b.h{i}.org/x", None) for i in range(0, 3000, 7)]
    for r in url_filter.judge(pages(spark, rows), rules).collect():
        assert r["rule"] == f"h{r['page_id']}.org/" and r["verdict"] == ("block" if r["page_id"] % 2 else "allow")


def test_distrust_reaches_all_linkers_of_a_blocked_host(spark):
    to = lambda *hosts: "".join(f"<a href='http://{h}/'>x</a>" for h in hosts)
    rows = [("http://hub.net/es/", to(*[f"farm{i}.org" for i in range(30)]))]
    rows += [(f"http://farm{i}.org/", to("hub.net")) for i in range(30)]  # linked back
    rows += [(f"http://sole{i}.org/", to("hub.net")) for i in range(100)]
    rows += [("http://second.org/", to("sole7.org")), ("http://other.net/es/", None), ("http://known.org/", to("other.net")), ("http://good.com/", to("known.org"))]
    rows += [("http://mixed.net/es/", None), *[(f"http://mixed.net/{i}", None) for i in range(9)], ("http://mild.org/", to("mixed.net"))]
    rows += [("http://alone.org/", to("mild.org", "clean.org"))]
    found = {r["host"]: r["verdict"] for r in url_filter.judge(pages(spark, [(i, *r) for i, r in enumerate(rows)]), queries.RULES).where("rule IS NULL").collect()}
    assert {h for h, v in found.items() if v == "block"} == {*[f"farm{i}.org" for i in range(30)], *[f"sole{i}.org" for i in range(100)], "second.org"}
    assert {h for h, v in found.items() if v == "allow"} == {"known.org", "mixed.net", "mild.org", "alone.org"}


def test_odd_tables(spark):
    assert url_filter.judge(pages(spark, []), queries.RULES).count() == 0
    twice = url_filter.judge(pages(spark, [LINKS[0], LINKS[0], (None, None, None), (9, "http://x.com/" + "p" * 50_000, "y" * 200_000)]), queries.RULES)
    assert twice.count() == 4
