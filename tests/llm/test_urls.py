from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import compare, connect
from factorspark.llm import urls

PAGES = [
    (1, "HTTP://Sub.Example.ORG/es/1?x#y", "<p>"),
    (2, "http://example.org/en/12", None),
    (3, "https://other.org", "a"),
    (4, "https://badexample.org/es/", "a"),
    (5, "nothing", "a"),
    (6, None, None),
    (7, "http://a.com/de/1", "<html>"),
    (8, "http://a.com/fr/1", '<link rel="canonical" href="/de/1">'),
    (9, "http://b.net/x", '<LINK href=http://a.com/de/1 rel=canonical>'),
    (10, "http://c.net/y#z", "<meta http-equiv='refresh' content='0; url=http://b.net/x'>"),
    (11, "http://d.net/", '<link rel="canonical" href="http://e.com/de/">'),
    (12, "http://e.com/de/", None),
    (13, "http://f.net/q", '<link rel="canonical" href="//d.net/">'),
    (13, "http://f.net/q", '<link rel="canonical" href="//d.net/">'),
    (14, "http://g.net/?a://b", '<link rel="canonical" href="relative">'),
    (15, "ftp://EXAMPLE.org:80/es/", ""),
    (16, "://", ""),
]
SCHEMA = "page_id bigint, url string, html string"
WANT = {
    1: ("sub.example.org", "/es/1", "example.org/es/", "block"),
    2: ("example.org", "/en/12", "example.org/en/1", "block"),
    3: ("other.org", "", None, "allow"),
    4: ("badexample.org", "/es/", "org/", "allow"),
    5: ("", "", None, "allow"),
    6: ("", "", None, "allow"),
    7: ("a.com", "/de/1", "com/de/", "block"),
    8: ("a.com", "/fr/1", "com/fr/", "allow"),
    9: ("b.net", "/x", None, "allow"),  # its component holds an allowed page
    10: ("c.net", "/y", None, "allow"),
    11: ("d.net", "/", None, "block"),
    12: ("e.com", "/de/", "com/de/", "block"),
    13: ("f.net", "/q", None, "block"),
    14: ("g.net", "/", None, "allow"),
    15: ("example.org:80", "/es/", None, "allow"),
    16: ("", "", None, "allow"),
}


def test_verdicts(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'x' AS node", "'y' AS verdict", "'z' AS allowed")
    got = urls.judge_urls(df).collect()
    assert len(got) == len(PAGES) and {r.page_id: tuple(r)[1:] for r in got} == WANT


@pytest.mark.parametrize("reference,want", [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"),
    ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q"), ("..", "http://a/b/"), ("../g", "http://a/b/g"),
    ("../..", "http://a/"), ("../../../g", "http://a/g"), ("g..", "http://a/b/c/g.."), ("./../g", "http://a/b/g"), ("g/./h", "http://a/b/c/g/h"),
    ("", "http://a/b/c/d;p?q"), ("ftp://x/./y", "ftp://x/y"), ("/l?next=http://x/", "http://a/l?next=http://x/"), ("mailto:a?b://c", None),
])
def test_references_of_rfc_3986(reference, want):
    assert urls.resolved("http://a/b/c/d;p?q", reference) == want


@pytest.mark.parametrize("url,html,target", [
    ("http://p.net/x/y", '<link rel="canonical" href="z">', "http://p.net/x/z"),
    ("http://p.net/x/y", '<link rel="canonical" href="../z">', "http://p.net/z"),
    ("http://p.net/x/y", "<link rel=canonical href=?a=1&amp;b=2>", "http://p.net/x/y?a=1&b=2"),
    ("http://p.net/x/y", '<link rel="nofollow canonical" href="/z">', "http://p.net/z"),
    ("http://p.net/x/y", '<link rel=canonical href="/1"><link rel=canonical href="/z">', "http://p.net/z"),
    ("http://p.net/x/y", '<meta http-equiv=refresh content="0;url=1"><meta content="5; URL=\'z\'" http-equiv="Refresh">', "http://p.net/x/z"),
    ("http://p.net/x/y", '<base href="/w/"><link rel=canonical href="z">', "http://p.net/w/z"),
    ("http://p.net/x/y", '<link rel=canonical href="http://q.net/a/../z">', "http://q.net/a/../z"),
])
def test_aliases_take_the_block(spark, url, html, target):
    host = target.split("/")[2]
    rules = (urls.Rule("block", host, "/" + target.split("/", 3)[3].split("?")[0]),)
    pages = [(1, url, html), (2, target, None)]
    if "?" in target:  # the path is that of the alias itself
        rules, pages = (urls.Rule("block", "q.net", "/"),), [*pages, (3, "http://q.net/", f'<link rel=canonical href="{target}">')]
    assert {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(pages, SCHEMA), rules).collect()}[1] == "block"


LINK = '<link rel=canonical href="http://b.com/y">'


@pytest.mark.parametrize("html", [
    f"<!-- {LINK} -->", f"<script>var x = '{LINK}';</script>", f"<template>{LINK}</template>", f"<title>{LINK}</title>", f"<style>{LINK}</style>",
    f"<textarea>{LINK}</textarea>", f"<p title='{LINK}'>", f"<script>{LINK}", f"<!-- {LINK}", "<link rel=canonical>", "<linkx rel=canonical href=http://b.com/y>",
])
def test_what_names_no_alias(html):
    assert urls.targets_of("http://a.com/x", html) == []
    assert urls.targets_of("http://a.com/x", html.replace("<script>", "<p>") + ("-->" if "<!--" in html else "</script>") + LINK) in (
        ["http://b.com/y"], ["http://b.com/y"] * 2)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert urls.judge_urls(df).count() == 0
    some = spark.createDataFrame(PAGES, SCHEMA)
    assert {r.verdict for r in urls.judge_urls(some, rules=()).collect()} == {"allow"}


def test_sql_on_fixture_and_tables(spark, tmp_path):
    link = lambda host: f'<link rel="x canonical" href="http://{host}/de/">'
    more = [
        (20, "http://h.net/1", f"<!-- {link('e.com')} --><title>{link('e.com')}</title><p>"), (21, "http://h.net/2", f"<script>'{link('e.com')}'</script>"),
        (22, "http://h.net/3", f"{link('i.net')}{link('e.com')}"), (23, "http://e.com/de/x", "<link rel=canonical href=y>"), (24, "http://e.com/de/y", None),
        (25, "http://h.net/a/b", '<link rel=canonical href="c">'), (26, "http://h.net/a/c", link("e.com")), (27, "http://h.net/?q", "<link rel=canonical href='?r&amp;s'>"),
        (28, "http://h.net/?r&s", link("e.com")), (29, "http://h.net/4", f"<script>{link('e.com')}"), (30, "http://h.net/5", "<link rel=canonical href='mailto:x'>"),
    ]
    rows = spark.createDataFrame(PAGES + more, SCHEMA)
    verdicts = {r.page_id: r.verdict for r in urls.judge_urls(rows).collect()}
    assert [verdicts[i] for i in (20, 21, 22, 25, 27, 29, 30)] == ["allow", "allow", "block", "block", "block", "allow", "allow"]
    rows.coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part-*")).rename(tmp_path / "pages.parquet")
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "op2_url_filter").startswith("ok")
    sf_dir = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf_dir), sf_dir, "op2_url_filter").startswith("ok")
    assert "op2_url_filter" in entry.queries()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_long_chain(spark, n):
    pages = [(i, f"http://h{i}.net/", f'<link rel=canonical href="http://h{i + 1}.net/">') for i in range(n)]
    pages.append((n, f"http://h{n}.net/", None))
    rules = (urls.Rule("block", f"h{n}.net", "/"),)
    assert {r.verdict for r in urls.judge_urls(spark.createDataFrame(pages, SCHEMA), rules).collect()} == {"block"}
