from __future__ import annotations

import random

import duckdb
import pytest

from touchpath.llm import urls

PAGES = "page_id long, url string, html string"
ODD = [
    (1, "http://A.com/de/1", '<a href="http://b.net/x">'), (2, "http://b.net/", "<a href='//C.net/?q'>x</a><a HREF=https://d.org/>"),
    (3, "http://c.net#z", '<a href="http://a.com/">'), (4, None, None), (5, "x.org/abc", "<a href='http://a.com'>"),
    (6, "http://d.org/k", "<a href=http://e.net/>"), (7, "http://e.net/p?x", ""), (8, "http://www.EXAMPLE.org/es/", ""),
    (9, "ftp://example.org/en/12?x", ""), (10, "http://notorg/", ""), (11, "http://a.org", ""), (None, "http://x.com/fr/?/de/", "<"),
    (2, "http://b.net/", "<a href='//C.net/?q'>x</a><a HREF=https://d.org/>"), (12, "http://notexample.org/es/", "x" * 200_000),
    (13, "http://a.example.org/en/1", ""), (14, "://", ""), (15, "http://u@h.org:80/es/://b.org/", ""), (16, "", ""),
]


def compare(spark, rows):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as host", "1 as rule", "2 as score", "'y' as path")
    got = sorted(map(tuple, urls.filter_urls(pages).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.oracle_sql()})").fetchall()
    assert got == sorted(want, key=repr) and len(got) == len(rows)
    return {r[0]: r for r in got}


def test_odd_pages_equal_duckdb(spark):
    got = compare(spark, ODD)
    assert got[8][1:] == ("www.example.org", "/es/", "example.org/es/", "block")
    assert got[13][3:] == ("example.org/en/1", "block") and got[12][3:] == ("org/", "allow")
    assert got[4][1:] == ("", "", None, "allow") and got[11][1:] == ("a.org", "", None, "allow")
    # Distrust runs against the links from a.com; trust along the link from d.org.
    assert [got[i][4] for i in (2, 3, 7)] == ["block", "block", "allow"]


def test_random_graph_with_a_hub_equals_duckdb(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'example.org'])}" for i in range(60)]
    rows = []
    for i in range(400):
        host = "hub.net" if i % 3 == 0 else rng.choice(hosts)
        links = "".join(f'<a href="https://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))
        rows.append((i, f"https://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{i}", links))
    compare(spark, rows)


def test_a_long_chain_is_followed_to_its_end(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(25)] + [(25, "http://h25.net/", '<a href="http://bad.com/">')]
    rows += [(99, "http://bad.com/de/", ""), (100, "http://far.net/", "")]
    got = compare(spark, rows)
    assert {got[i][4] for i in range(26)} == {"block"} and got[100][4] == "allow"


def test_scores_equal_brute_force(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("b", "e")]
    seeds = [("trust", "a"), ("trust", "d"), ("distrust", "e")]
    got = {r.host: (r.trust, r.distrust) for r in urls.host_scores(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "kind string, host string")).collect()}
    for at, kind in enumerate(("trust", "distrust")):
        ways = edges if kind == "trust" else [(b, a) for a, b in edges]
        start = {h: 1 / sum(k == kind for k, _ in seeds) for k, h in seeds if k == kind}
        state = dict(start)
        for _ in range(200):
            new = {h: 0.15 * s for h, s in start.items()}
            for a, b in ways:
                new[b] = new.get(b, 0) + 0.85 * state.get(a, 0) / sum(x == a for x, _ in ways)
            state = new
        for host, score in state.items():
            assert got[host][at] == pytest.approx(score, abs=1e-5)


def test_empty_table_and_other_rules(spark):
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).collect() == []
    none = urls.filter_urls(spark.createDataFrame(ODD, PAGES), urls.UrlOptions(rules=()))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
