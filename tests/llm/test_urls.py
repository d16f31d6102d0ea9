import time

import numpy as np
import pytest

from millrace.llm import urls
from tests.oracle import same

PAGES = "page_id bigint, url string, html string, rule string, trust string"


def judged(spark, rows, **how):
    got = urls.filtered(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES), **how)
    return {(r["page_id"]): r for r in got.collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [
        (1, "https://A.Example.ORG/es/x?y", None), (2, "http://example.org/en/12", ""), (3, "http://example.org/en/2", ""),
        (4, "nothing", ""), (5, None, ""), (6, "x://shop.com/fr/1#t", ""), (7, "x://acom/fr/1", ""), (8, "x://net", ""), (9, "x://b.org", ""),
        (9, "x://b.org", ""),
    ])
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.org/en/1", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("org/", "allow")
    assert (got[4]["host"], got[4]["path"], got[4]["verdict"]) == ("", "", "allow")
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("", "", None)
    assert got[6]["rule"] == "com/fr/" and got[7]["rule"] is None and got[8]["path"] == "" and got[9]["rule"] is None


def test_trust_and_distrust_follow_links(spark):
    link = lambda h: f"<p><a class='x' href='http://{h}/a'>t</a> <a href=\"/in\">i</a>"
    got = judged(spark, [
        (1, "http://good.org/a", link("friend.net")), (2, "http://friend.net/", link("next.net")), (3, "http://next.net/", ""),
        (4, "http://bad.com/de/1", ""), (5, "http://shill.net/", link("BAD.com") * 3), (6, "http://alone.net/", link("nowhere.net")),
    ])
    assert got[2]["verdict"] == got[3]["verdict"] == got[6]["verdict"] == "allow" and got[5]["verdict"] == "block"
    assert got[2]["trust"] > got[3]["trust"] > 0 and got[5]["distrust"] > 0 and got[6]["trust"] is None


def test_against_power_iteration(spark):
    hosts = ["a.org", "b.net", "c.net", "d.com", "e.net"]
    links = {("a.org", "b.net"): 2, ("a.org", "c.net"): 1, ("b.net", "c.net"): 1, ("c.net", "d.com"): 3, ("e.net", "d.com"): 1, ("d.com", "a.org"): 1}
    rows = [(i, f"http://{h}{'/de/x' if h == 'd.com' else '/x'}", "".join(f'<a href="//{t}">' * n for (s, t), n in links.items() if s == h)) for i, h in enumerate(hosts)]
    got = {r["host"]: r for r in judged(spark, rows, rounds=12, tolerance=0.0).values()}
    for kind, seed, edges in (("trust", "a.org", links), ("distrust", "d.com", {(t, s): n for (s, t), n in links.items()})):
        out = {h: sum(n for (s, _), n in edges.items() if s == h) for h in hosts}
        rank = {h: float(h == seed) for h in hosts}
        for _ in range(12):
            rank = {h: 0.15 * (h == seed) + 0.85 * sum(rank[s] * n / out[s] for (s, t), n in edges.items() if t == h) for h in hosts}
        for h in hosts:
            assert (got[h][kind] or 0.0) == pytest.approx(rank[h], abs=1e-12)


def test_ranks_settle_on_a_long_chain_and_a_cycle(spark, monkeypatch):
    ring, chain = [f"r{i:02}.net" for i in range(12)], [f"n{i:02}.net" for i in range(14)]
    links = {(a, b): 1 for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)} | {(a, b): 1 for a, b in zip(chain, [*chain[1:], "d.com"], strict=True)}
    links |= {("a.org", "r00.net"): 1, ("r05.net", "d.com"): 2, ("r11.net", "n00.net"): 1}
    hosts = sorted({h for e in links for h in e})
    rows = [(i, f"http://{h}{'/de/x' if h == 'd.com' else '/x'}", "".join(f'<a href="//{t}">' * n for (s, t), n in links.items() if s == h)) for i, h in enumerate(hosts)]
    pages = judged(spark, rows)
    got = {r["host"]: r for r in pages.values()}
    exact = {}
    for kind, seed, edges in (("trust", "a.org", links), ("distrust", "d.com", {(t, s): n for (s, t), n in links.items()})):
        at = {h: i for i, h in enumerate(hosts)}
        m = np.eye(len(hosts))
        for (s, t), n in edges.items():
            m[at[t], at[s]] -= 0.85 * n / sum(k for (f, _), k in edges.items() if f == s)
        exact[kind] = dict(zip(hosts, np.linalg.solve(m, [0.15 * (h == seed) for h in hosts]), strict=True))
        for h in hosts:
            assert (got[h][kind] or 0.0) == pytest.approx(exact[kind][h], rel=1e-4), (kind, h)
    for h in set(hosts) - {"a.org", "d.com"}:
        assert got[h]["verdict"] == ("block" if exact["distrust"][h] >= max(2 * exact["trust"][h], 0.05 * 0.15) else "allow"), h
    far = [(i, f"http://{h}{'/de/x' if h == 'd.com' else '/x'}", f'<a href="//{t}">' if t else "") for i, (h, t) in enumerate(zip([*chain, "d.com"], [*chain[1:], "d.com", ""], strict=True))]
    assert {r["verdict"] for r in judged(spark, far).values()} == {"block"}
    monkeypatch.setattr(urls, "MOST_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="3 rounds"):
        judged(spark, far)


def test_a_trace_of_distrust_blocks_no_host(spark):
    many = "".join(f'<a href="//other{i}.net">' for i in range(400))
    got = judged(spark, [(1, "http://hub.net/", many + '<a href="//bad.com">'), (2, "http://shill.net/", '<a href="//bad.com">'), (3, "http://bad.com/de/", ""), (4, "http://far.net/", '<a href="//hub.net">'), *((10 + i, f"http://s{i}.net/", '<a href="//shill.net">') for i in range(30))])
    assert got[1]["distrust"] > 0.05 * 0.15 and got[1]["verdict"] == got[2]["verdict"] == "block"
    few = [r for r in got.values() if r["host"].startswith("s") and r["host"] != "shill.net"]
    assert all(r["distrust"] > 0 and r["verdict"] == ("block" if r["distrust"] >= 0.05 * 0.15 else "allow") for r in few) and {r["verdict"] for r in few} == {"allow"}


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_against_sql(spark, data):
    same(spark, urls.op1_url_filter, urls.sql(), data)


def test_long_pages_without_links_are_searched_in_a_pass(spark):
    """Tags that never end, many spaces and many attributes: time grows with the length, not with its square."""
    judged(spark, [(1, "http://a.net/x", "<a ")])
    began = time.time()
    got = judged(spark, [(1, "http://a.net/x", "<a " * 10**6 + "href='//b.net/'"), (2, "http://b.net/", "<a href " * 10**5), (3, "http://c.net/", "<a href" + " " * 10**6 + "=x"), (4, "http://d.com/de/", "")], rounds=1)
    assert len(got) == 4 and time.time() - began < 20


def test_edges_of_odd_tags(spark):
    html = """<a data-href="//no.net/" HREF='https://Yes.net:80/x'>y</a><a
    class=x
    href=//two.net><abbr href="//no.org"><a title="x" href="/in"><a href="mailto:x"><a href='//two.net#t' href='//no.com'>"""
    rows = spark.createDataFrame([("me.net", html)], "host string, html string")
    assert sorted(map(tuple, urls.host_edges(rows).collect())) == [("me.net", "two.net", 2), ("me.net", "yes.net:80", 1)]
