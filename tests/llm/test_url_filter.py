from __future__ import annotations

import random
import re

import duckdb
import pytest

from concordat.llm import url_filter

PLACES = ["a.org", "www.a.org", "b.a.org", "xa.org", "spam-farm.b.net", "x.spam-farm.b.net", "spam-farm.net", "m.com", "example.org", "WWW.Example.ORG:80", "e.example.org", "q.com:443", "q.com:8080", "free-bets.c.com", "ÀB.net", "www.net"]
PATHS = ["", "/", "/es/", "/es", "/en/1", "/en/12.html", "/en/2/", "/fr/x", "/de/x/index.html", "/a//", "/line\n", "/é"]
ENDS = ["", "?", "?utm_source=a", "?b=2&a=1&ref=x", "?a=1&b=2", "#top", "?x#y?z"]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    found = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest)
    return re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2], found[3] or ""


def site_of(host):
    return re.sub(r"^(?:www|m)\.([^.]+\.)", r"\1", re.sub(r":(?:80|443)?\Z", "", host))


def canonical(url):
    host, path, query = parts(url)
    path = re.sub(r"(?:/index)?(?:\.html)?/*\Z", "", path)
    kept = "&".join(sorted(p for p in query.split("&") if p and not re.match(r"(?:utm_[^=]*|ref)(?:=|\Z)", p)))
    return site_of(host) + (path or "/") + (f"?{kept}" if kept else "") if host else None


def expected(rows, listed, rules):
    out = []
    for i, url in rows:
        host, path, _ = parts(url)
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        labels = site_of(host).split(".")
        keys = {canonical(url), *(".".join(labels[k:]) + "/" for k in range(max(len(labels) - 1, 1)))} if host else set()
        out.append((i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if keys & listed else "allow"))
    return sorted(out, key=repr)


def urls():
    random.seed(3)
    rows = [(i, f"{random.choice(['http', 'https', 'a://b'])}://{random.choice(PLACES)}{random.choice(PATHS)}{random.choice(ENDS)}") for i in range(600)]
    return [*rows, (1, None), (None, "http://spam-farm.b.net/x"), (7, "no scheme/www.a.org"), (8, "://"), (9, ""), (10, "http://" + "a." * 600 + "spam-farm.b.net/"), (11, "http://q.com/" + "x" * 100_000), (12, "http://spam-farm.b.net/x"), (12, "http://spam-farm.b.net/x")]


@pytest.mark.parametrize("blocks", [1, url_filter.MAX_BLOCKS])
def test_matches_brute_force_whatever_the_size_of_the_filter(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    rows = urls()
    listed = {canonical(u) for _, u in rows[:150] if u} | {"spam-farm.b.net/", "c.com/", "never.seen/x"} - {"/"}
    table = spark.createDataFrame([(*r, "h", 1, 2) for r in rows], "page_id long, url string, host string, rule int, block int")
    got = url_filter.judge(table, spark.createDataFrame([(x,) for x in listed] + [(None,), ("c.com/",)], "key string"), url_filter.RULES)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, listed, url_filter.RULES)


def test_the_filter_lets_few_others_pass_and_none_of_its_own_fail(spark):
    own = spark.range(20_000).selectExpr("concat('in/', id) AS key")
    rows, blocks = url_filter.bloom(own, 20_000)
    assert blocks == 469
    assert url_filter.passed(own, rows, blocks).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('out/', id) AS key")
    assert url_filter.passed(others, rows, blocks).count() < 400


def test_query_equals_its_sql(spark, tmp_path):
    rows = urls()
    pages = spark.createDataFrame([(*r, "<p>") for r in rows], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op12_url_filter(spark, str(tmp_path))
    assert "Python" not in got._jdf.queryExecution().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got.columns == con.sql(url_filter.OP12_SQL).columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(url_filter.OP12_SQL).fetchall(), key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    assert url_filter.judge(pages, none, url_filter.RULES).collect() == []
    one = spark.createDataFrame([(1, "http://q.com/de/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, none, url_filter.RULES).collect()] == [(1, "q.com", "/de/", "com/de/", "block")]
    assert [tuple(r) for r in url_filter.judge(one, none, []).collect()] == [(1, "q.com", "/de/", None, "allow")]
