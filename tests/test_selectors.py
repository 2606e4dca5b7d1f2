"""Selectors against a slow matcher of their own, and the shortest selector of each element of whole pages."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillflow.functions import selectors
from quillflow.functions.html import parse, parsed
from quillflow.operators import pages

PAGE = """<html><body><div id=nav class="top bar"><a href=/>home</a><a href="https://x.example/a" rel="nofollow next">x</a></div>
<ul id="list" class="toc wide"><li><a href="/1">第1章 一</a></li><li class=odd><a href="/2">第2章 二</a><img src=a.png></li><li><a href="/3" lang="zh-CN">第3章 三</a></li><li><b>4</b></li></ul>
<div class=toc><p>one<br>two</p><p class="odd wide">three <span>four</span></p></div><div id="9a:b"><p>last text of the page</p></div></body></html>"""

CASES = {
    "#list": [("ul", "list")], "ul.toc": 1, ".toc": 2, ".wide.odd": 1, "li": 4, "li:first-child": 1, "li:last-child a": 0, "li:nth-child(2) > a": 1, "li:nth-child(odd)": 2, "li:nth-child(2n)": 2, "li:nth-child(-n+3)": 3, "li:nth-last-child(1)": 1,
    "p:nth-of-type(2)": 1, "a[href]": 5, "a[href^='/']": 4, "a[href$=\"/a\"]": 1, "a[rel~=next]": 1, "a[lang|=zh]": 1, "a[href*=example]": 1, "a[href='/2'] + img": 1, "li.odd ~ li": 2, "li.odd + li": 1, "ul a, div.toc span": 4,
    "body > div p": 3, "body div > p span": 1, "li:not(.odd) a": 2, "div:not(#nav):not([class])": 1, "*": None, "p:only-child": 1, "#\\39 a\\:b > p": 1, "#\\39 a": 0, "div[id='9a:b'] p": 1, "body > ul li:first-of-type a": 1, "a[href^='']": 0, "html:root": 1,
}


@pytest.fixture(scope="module")
def page(spark):
    return parsed(spark.createDataFrame([(1, PAGE)], "page_id int, html string"), "page_id", nodes=True).cache()


def test_selectors(page):
    got = page.select(*[F.size(selectors.selected("nodes", s)).alias(str(i)) for i, s in enumerate(CASES)]).first()
    n = len(parse(PAGE, True)["nodes"])
    wanted = {s: n if w is None else len(w) if isinstance(w, list) else w for s, w in CASES.items()}
    assert {s: got[str(i)] for i, s in enumerate(CASES)} == wanted


@pytest.mark.parametrize("wrong", ["", " ", "a >", "> a", "a[", "a:hover", "a:nth-child(x)", "p:", "a {"])
def test_no_selectors(wrong):
    with pytest.raises(ValueError):
        selectors.matches(F.col("nodes"), F.col("e"), wrong)


def fits(node, step):
    """A slow reading of the few forms that `shortest` writes."""
    if step.startswith("#"):
        return node["id"] == selectors._plain(step[1:])
    found = re.fullmatch(r"([\w-]+)((?:\.(?:\\.|[\w-])+)*)(?::nth-of-type\((\d+)\))?", step)
    classes = [re.sub(r"\\(.)", r"\1", c) for c in re.findall(r"\.((?:\\.|[\w-])+)", found[2])]
    return node["tag"] == found[1] and set(classes) <= set(node["classes"]) and (not found[3] or node["of_type"] == int(found[3]))


def alone(nodes, at):
    steps = nodes[at]["selector"].split(" > ")

    def chain(i, k):
        return fits(nodes[i], steps[k]) and (k == 0 and (len(steps) == 1 or steps[0].startswith("#") or nodes[i]["parent"] < 0) or k > 0 and nodes[i]["parent"] >= 0 and chain(nodes[i]["parent"], k - 1))

    return [n["at"] for n in nodes if chain(n["at"], len(steps) - 1)] == [at]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_each_element_of_all_pages_is_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for html in [PAGE, *(r.html for r in rows)]:
        nodes = parse(html, True)["nodes"]
        assert all(alone(nodes, n["at"]) for n in nodes)


def test_shortest_by_the_engine(page):
    nodes = parse(PAGE, True)["nodes"]
    got = page.select(*[F.transform(selectors.selected("nodes", n["selector"]), lambda e: e["at"]).alias(str(n["at"])) for n in nodes]).first()
    assert {n["at"]: got[str(n["at"])] for n in nodes} == {n["at"]: [n["at"]] for n in nodes}
    by = {n["selector"] for n in nodes}
    assert {"#list", "#nav", "img", "li.odd", "#\\39 a\\:b"} <= by


def test_selectors_of_ones_own(spark, page):
    with_url = page.withColumn("url", F.lit("http://h.example/b/"))
    links = pages.toc_links(with_url, selector="ul.toc.wide", link_selector="li:not(.odd) > a").collect()
    assert [(r["index"], r.url) for r in links] == [(1, "http://h.example/1"), (2, "http://h.example/3")]
    assert pages.extract(page, selector="div.toc > p:nth-of-type(2)").first().content == "three four"
    assert pages.extract(page, selector="nothing").first().content == pages.extract(page).first().content
    found = pages.probe(with_url, selector="ol", link_selector="a").first()
    assert not found.ok and found.reason == "toc_selector_not_found"
    empty = pages.probe(with_url, selector="li:last-child").first()
    assert not empty.ok and empty.reason == "no_toc"
    plain = parsed(spark.createDataFrame([(1, PAGE)], "page_id int, html string"), "page_id")
    with pytest.raises(ValueError):
        pages.extract(plain, selector="div > p")
    none = parsed(spark.createDataFrame([(1, None), (2, "")], "page_id int, html string"), "page_id", nodes=True)
    assert [r.nodes for r in none.collect()] == [[], []] and pages.extract(none, selector="p").count() == 2
