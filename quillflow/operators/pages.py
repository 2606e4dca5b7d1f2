"""Web pages: tables of contents, content blocks, titles and authors, chapters, and whether a page may be read."""

from __future__ import annotations

import re
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.functions import selectors
from quillflow.functions.text import WS, char_count, collapse, trim
from quillflow.functions.titles import NUMERAL
from quillflow.functions.urls import absolute, host, valid_link
from quillflow.operators.cleaning import ad_label

# How pages name chapters, the next page, the next chapter and their navigation; where content usually stands.
CHAPTER_LIKE = f"(?i)(第{WS}*[{NUMERAL}]{{1,12}}{WS}*[章回节卷篇集]|Chapter{WS}*\\d{{1,5}}|序章|楔子|引子|番外|尾声|后记|终章|大结局)"
NEXT_PAGE = f"(?i)^{WS}*(?:下一页|下页|下一頁|后一页|next|›|»|>){WS}*$"
NEXT_CHAPTER = "(?i)下一[章节回]|下章"
NAVIGATION = "^(上一章|下一章|上一页|下一页|回目录|目录|返回书页|加入书签|推荐本书|手机阅读|章节报错)$"
CONTENT = ["#content", "#chaptercontent", "#chapterContent", "#booktext", "#htmlContent", "#nr1", "#nr", ".content", ".chapter-content", ".read-content", ".showtxt", ".yd_text2", "article", ".article-content"]
LEAST_CONTENT, LEAST_TOC = 40, 5.0
# Fixed value: what sites put behind a title.
TITLE_TAIL = "[（(]?(最新章节|全文阅读|免费阅读|无弹窗|全文免费阅读)[）)]?$"
LOGIN = [
    (f"请{WS}*(?:先)?登录(?:后|再)?(?:阅读|查看|继续)?", '页面提示"请登录后阅读"'),
    ("登录(?:后|才)(?:可|能)(?:查看|阅读|继续)", '页面提示"登录才能查看"'),
    ("(?:会员|账号)?登录(?:页面|窗口|框)?", "出现登录入口"),
    ("立即登录|马上登录|去登录|未登录", '出现"立即登录"提示'),
    ("(?i)<input[^>]+type=[\"']?password", "页面里有密码输入框"),
]
PAYWALL = [
    (f"(?i)VIP{WS}*(?:章节|会员|专享|阅读)", "标记为 VIP 章节"),
    ("(?:本章|该章|此章)(?:为)?付费(?:章节)?", "标记为付费章节"),
    ("付费阅读|付费章节|付费内容", '出现"付费阅读"'),
    (f"(?i)(?:开通|成为|升级){WS}*VIP|开通会员|加入会员", "要求开通会员"),
    ("(?:购买|订阅)(?:本章|全书|本书|后阅读)", "要求购买或订阅"),
    (f"(?:书币|阅点|金币|余额){WS}*(?:不足|不够)", "货币不足提示"),
    ("试读(?:结束|完毕)|试读到此为止", "试读结束提示"),
    ("本章尚未购买|尚未订阅", "尚未购买提示"),
]
AGENT = "quillflow/0.1"


def valid_links(links: Column) -> Column:
    return F.filter(links, lambda x: valid_link(x["href"], x["title"]))


def page_links(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Every link to another page once (where it stands first): key, n, title, href, link (absolute)."""
    rows = parsed.select(key, url, F.explode(valid_links(F.col("links"))).alias("x")).select(key, url, F.col("x.n").alias("n"), F.col("x.title").alias("title"), F.col("x.href").alias("href"))
    rows = rows.withColumn("link", absolute(F.col(url), F.col("href"))).filter("link is not null")
    first = Window.partitionBy(key, "link").orderBy("n")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", url)


def group_score(links: Column, depth: Column) -> Column:
    """How much a group of links looks like a table of contents: chapter titles count for it, in number and share, other links against it."""
    n = F.size(links)
    like = F.size(F.filter(links, lambda x: x["title"].rlike(CHAPTER_LIKE)))
    different = F.size(F.array_distinct(F.transform(links, lambda x: x["href"])))
    mean = F.aggregate(links, F.lit(0), lambda s, x: s + F.length(x["title"])) / n
    short = F.when(mean.between(2, 26), 1.0).otherwise(0.3)
    return F.when(n >= 3, 2 * like + 20 * like / n - 1.2 * (n - like) + 0.5 * F.least(different, F.lit(6)) + 2 * short + 0.3 * F.least(depth, F.lit(8))).otherwise(-1.0)


def toc_candidates(parsed: DataFrame, key: str = "page_id", most: int = 10, least: float = LEAST_TOC) -> DataFrame:
    """The best groups of links of each page that score least or more: key, place, selector, depth, n_links, score, first_link. Deeper elements win ties."""
    rows = parsed.select(key, "links", F.explode("elements").alias("e")).filter("e.n_links >= 3 and e.tag not in ('html', 'body', 'head')")
    own = valid_links(F.slice("links", F.col("e.first_link") + 1, F.col("e.n_links")))
    rows = rows.withColumn("own", own)
    scored = rows.select(key, F.col("e.selector").alias("selector"), F.col("e.depth").alias("depth"), F.size("own").alias("n_links"), F.round(group_score(F.col("own"), F.col("e.depth")), 6).alias("score"), F.col("e.first_link").alias("first_link")).filter(F.col("score") >= least)
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("depth").desc(), "first_link", "selector")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most)


def toc_links(parsed: DataFrame, key: str = "page_id", url: str = "url", selector: str | None = None, link_selector: str | None = None) -> DataFrame:
    """key, index, title, url: the links of each page's best table of contents, or of the first element that the selector names, absolute, each where it stands first.

    link_selector: only links within that fit it. Selectors need pages parsed with their nodes.
    """
    if selector:
        chosen = _named(parsed, selector)
        ranges = parsed.select(F.col(key).alias("_key"), chosen.alias("e")).select("_key", F.col("e.first_link").alias("_f"), F.col("e.n_links").alias("_n")).filter("_n > 0")
    else:
        best = toc_candidates(parsed, key, 1).select(F.col(key).alias("_key"), "first_link", "selector")
        spans = parsed.select(F.col(key).alias("_k"), F.explode("elements").alias("e")).select("_k", F.col("e.selector").alias("_s"), F.col("e.first_link").alias("_f"), F.col("e.n_links").alias("_n"))
        ranges = best.join(spans, (F.col("_key") == F.col("_k")) & (F.col("selector") == F.col("_s")) & (F.col("first_link") == F.col("_f"))).groupBy("_key", "_f").agg(F.max("_n").alias("_n"))
    links = page_links(parsed, key, url)
    inside = links.join(ranges, (F.col(key) == F.col("_key")) & (F.col("n") >= F.col("_f")) & (F.col("n") < F.col("_f") + F.col("_n")))
    if link_selector:
        fitting = F.filter(selectors.selected("nodes", link_selector), lambda e: e["link"] >= 0)
        wanted = parsed.select(F.col(key).alias("_k2"), F.explode(F.transform(fitting, lambda e: e["link"])).alias("_l"))
        inside = inside.join(wanted, (F.col(key) == F.col("_k2")) & (F.col("n") == F.col("_l")), "left_semi")
    order = Window.partitionBy(key).orderBy("n")
    return inside.select(key, F.row_number().over(order).alias("index"), "title", F.col("link").alias("url"))


def probe(parsed: DataFrame, key: str = "page_id", url: str = "url", selector: str | None = None, sample: int = 5, most: int = 8, link_selector: str | None = None) -> DataFrame:
    """What each page is worth as a table of contents: ok, reason (toc_selector_not_found or no_toc), title, author, site, selector, n_links, sample
    (the first links), candidates (the best groups of links), next_href and warnings (few_links below three)."""
    found = toc_candidates(parsed, key, most)
    listed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "selector", "n_links", "score"))).alias("candidates"))
    links = toc_links(parsed, key, url, selector, link_selector).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "title", "url"))).alias("_links"))
    there = _named(parsed, selector).isNotNull() if selector else F.lit(True)
    rows = parsed.select(key, there.alias("_there"), next_page().alias("next_href")).join(listed, key, "left").join(links, key, "left").join(book_meta(parsed, key, url), key)
    n = F.coalesce(F.size("_links"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    reason = F.when(~F.col("_there"), "toc_selector_not_found").when(n == 0, "no_toc")
    own = F.when(n > 0, F.lit(selector) if selector else F.col("candidates")[0]["selector"])
    few = F.when((n > 0) & (n < 3), F.array(F.lit("few_links"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        key, reason.isNull().alias("ok"), reason.alias("reason"), "title", "author", "site", own.alias("selector"), n.alias("n_links"), F.slice("_links", 1, sample).alias("sample"), "candidates", "next_href", few.alias("warnings")
    )


def content_candidates(parsed: DataFrame, key: str = "page_id", most: int = 10) -> DataFrame:
    """The best blocks of text of each page: key, place, selector, n_chars, score. Blocks that are half links are left out."""
    rows = parsed.select(key, F.posexplode("elements").alias("i", "e")).filter(F.col("e.tag").isin("div", "article", "section", "td", "main") & (F.col("e.n_chars") >= LEAST_CONTENT))
    ratio = F.col("e.n_link_chars") / F.greatest(F.col("e.n_solid"), F.lit(1))
    score = 0.5 * F.col("e.n_chars") / F.col("e.n_tags") + 0.02 * F.col("e.n_chars") + 3 * F.col("e.n_br") + 2 * F.col("e.n_p") - 40 * ratio
    scored = rows.filter(ratio <= 0.5).select(key, "i", F.col("e.selector").alias("selector"), F.col("e.n_chars").alias("n_chars"), F.round(score, 6).alias("score"))
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "i")
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).drop("i")


def _fits(e: Column, selector: str) -> Column:
    if selector[0] == "#":
        return e["id"] == selector[1:]
    if selector[0] == ".":
        return F.array_contains(F.split(e["class"], r"\s+"), selector[1:])
    return e["tag"] == selector


def _named(parsed: DataFrame, selector: str) -> Column:
    """The first element that a selector names: any selector where the pages were parsed with their nodes, else #id, .class or a tag among the elements that are kept."""
    if "nodes" in parsed.columns:
        return selectors.first("nodes", selector)
    if not re.fullmatch(r"[#.]?[\w-]+", selector):
        raise ValueError(f"pages must be parsed with nodes=True for {selector}")
    return F.try_element_at(F.filter("elements", lambda e: _fits(e, selector)), F.lit(1))


def content_block() -> Column:
    """The element of a parsed page that holds its content: a usual one that is long enough, or the best scored."""
    first = lambda s, least: F.try_element_at(F.filter("elements", lambda e: _fits(e, s) & (e["n_chars"] >= least)), F.lit(1))
    usual = [first(s, LEAST_CONTENT) for s in CONTENT]

    def score(e: Column) -> Column:
        ratio = e["n_link_chars"] / F.greatest(e["n_solid"], F.lit(1))
        return F.when((e["n_chars"] >= LEAST_CONTENT) & (ratio <= 0.5), 0.5 * e["n_chars"] / e["n_tags"] + 0.02 * e["n_chars"] + 3 * e["n_br"] + 2 * e["n_p"] - 40 * ratio)

    ranked = F.array_sort(F.filter(F.transform("elements", lambda e, i: F.struct((-score(e)).alias("s"), i.alias("i"), e.alias("e"))), lambda x: x["s"].isNotNull()))
    best = F.try_element_at(F.transform(ranked, lambda x: x["e"]), F.lit(1))
    return F.coalesce(*usual, best)


def content_text(parsed: DataFrame, selector: str | None = None) -> Column:
    """The text of the element that the selector names, if it has any; else that of the page's content."""
    found = content_block()["text"]
    if not selector:
        return found
    chosen = _named(parsed, selector)
    own = F.substring("own_text", chosen["start"] + 1, chosen["size"]) if "nodes" in parsed.columns else chosen["text"]
    return F.when(own.rlike("\\S"), own).otherwise(found)


def extract(parsed: DataFrame, key: str = "page_id", selector: str | None = None) -> DataFrame:
    """key, title, content, n_removed, char_count, next_href: a page's text without navigation and advertising lines, and the page that goes on with it."""
    lines = F.transform(F.split(F.coalesce(content_text(parsed, selector), F.lit("")), "\n"), lambda x: trim(F.regexp_replace(x, "[ \\t\\u00a0\\u3000]+", " ")))
    tested = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(x.rlike(NAVIGATION), "导航行").otherwise(ad_label(x)).alias("reason")))
    rows = parsed.withColumn("_t", tested)
    kept = F.array_join(F.transform(F.filter("_t", lambda x: x["reason"].isNull()), lambda x: x["line"]), "\n")
    content = trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))
    heading = F.coalesce(F.nullif(F.col("h1"), F.lit("")), F.col("title"))
    title = trim(F.element_at(F.split(heading, r"[_\-|]"), 1))
    return rows.select(key, title.alias("title"), content.alias("content"), F.size(F.filter("_t", lambda x: x["reason"].isNotNull())).alias("n_removed"), char_count(content).alias("char_count"), next_page().alias("next_href"))


def next_page() -> Column:
    """The link to the next page of what a parsed page shows; null if there is none or it leads to the next chapter."""
    first = F.try_element_at(F.filter("links", lambda x: x["title"].rlike(NEXT_PAGE)), F.lit(1))
    return F.when(~first["title"].rlike(NEXT_CHAPTER) & ~first["title"].rlike(CHAPTER_LIKE), first["href"])


def book_meta(parsed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, title, author, site as a page's own title and marks tell them."""
    raw = F.col("title")
    three, bracket, two = r"^(.+?)\s*[_\-|]\s*(.+?)\s*[_\-|]\s*(.+)$", r"^(.+?)\s*[（(]([^）)]+)[）)]", r"^(.+?)\s*[-_|]\s*(.+)$"
    name, author = raw, F.lit("")
    for pattern in (two, bracket, three):
        fits = raw.rlike(pattern)
        name, author = F.when(fits, F.regexp_extract(raw, pattern, 1)).otherwise(name), F.when(fits, F.regexp_extract(raw, pattern, 2)).otherwise(author)
    marked = F.regexp_extract("body", r"作者[：:]\s*([^\s<|]{1,20})", 1)
    site = host(F.col(url))
    title = trim(F.regexp_replace(trim(name), TITLE_TAIL, ""))
    return parsed.select(key, F.coalesce(F.nullif(title, F.lit("")), F.nullif(site, F.lit("")), F.lit("未命名")).alias("title"), F.coalesce(F.nullif(trim(author), F.lit("")), marked).alias("author"), site.alias("site"))


def evidence(html: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(label)) for p, label in patterns]))


def walls(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, login and paywall (what shows them; empty if nothing does), from the page as it came."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(key, evidence(html, LOGIN).alias("login"), evidence(html, PAYWALL).alias("paywall"))


def robots(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", agent: str = AGENT) -> DataFrame:
    """pages with allowed and crawl_delay. rules: origin, status, robots (the text). Without readable rules all is allowed.

    Pages meet their site's rules by origin; each batch reads a rule text once.
    """
    origin = F.concat(F.lower(F.try_parse_url(F.col(url), F.lit("PROTOCOL"))), F.lit("://"), host(F.col(url)))
    joined = pages.withColumn("_origin", origin).join(rules.filter("status = 200").select(F.col("origin").alias("_origin"), F.col("robots").alias("_robots")), "_origin", "left")

    @F.pandas_udf("allowed boolean, crawl_delay double")
    def judge(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, text in zip(urls, texts):
            if not text:
                out.append((True, None))
                continue
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            delay = parsers[text].crawl_delay(agent)
            out.append((parsers[text].can_fetch(agent, u or ""), float(delay) if delay else None))
        return pd.DataFrame(out, columns=["allowed", "crawl_delay"])

    return joined.withColumn("_r", judge(F.col(url), F.col("_robots"))).withColumns({"allowed": F.col("_r.allowed"), "crawl_delay": F.col("_r.crawl_delay")}).drop("_origin", "_robots", "_r")


def inspect(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, reason: the first of bad_url, robots, network, http_error, login, paywall that keeps a page from being read; null if nothing does.

    pages: html and status (null: it could not be opened).
    """
    html = F.coalesce("html", F.lit(""))
    scheme = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("PROTOCOL")), F.lit("")))
    judged = robots(pages, rules, key, url)
    reason = (
        F.when(~scheme.isin("http", "https") | (host(F.col(url)) == ""), "bad_url").when(~F.col("allowed"), "robots").when(F.col("status").isNull(), "network").when(~F.col("status").between(200, 299), "http_error")
        .when(F.size(evidence(html, LOGIN)) > 0, "login").when(F.size(evidence(html, PAYWALL)) > 0, "paywall")
    )
    return judged.select(key, reason.alias("reason"))


def same_chapter(a: Column, b: Column) -> Column:
    """Whether two texts begin alike: 200 characters without white space, over 20 of them there."""
    start = lambda c: F.left(F.regexp_replace(c, f"{WS}+", ""), F.lit(200))
    return (start(a) == start(b)) & (F.length(start(a)) > 20)


def visible(html: Column) -> Column:
    """A page's text by patterns alone: for tests of presence, where no structure is needed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|iframe|noscript)\b.*?</\1>", " ")
    return collapse(F.regexp_replace(bare, "<[^>]*>", " "))
