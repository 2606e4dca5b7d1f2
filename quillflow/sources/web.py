"""Fetching pages: by host, paced, two of a host at once, with retries, each page decoded by what its header says or what its bytes look like."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillflow.functions.encoding import CODECS, detect_one
from quillflow.functions.html import parsed
from quillflow.functions.urls import absolute, host
from quillflow.operators import pages as P
from quillflow.operators.fetching import CONCURRENT, INTERVAL_MS
from quillflow.sources.limits import Limiter, at_once
from quillflow.sources.shared import settled

AGENT, TIMEOUT_S, PAGES = "quillflow/0.1", 20, 20
FIRST_DELAY_S, RETRIES = 0.8, 3
#: Seconds between two requests to one host; a machine's own address needs less.
INTERVAL_S = INTERVAL_MS / 1000
#: Statuses after which another try may do better.
AGAIN = {408, 425, 429, 500, 502, 503, 504}


def read_text(data: bytes, content_type: str | None) -> tuple[str, str]:
    """A page's text and its encoding's name."""
    named = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", data[:2048], re.I)
    name = named[1].decode("ascii", "replace") if named and isinstance(named[1], bytes) else named[1] if named else None
    try:
        if name:
            return data.decode(name, "replace"), name
    except LookupError:
        pass
    found = detect_one(data)[0]
    return data.decode(CODECS[found], "replace"), found


def get(url: str, agent: str = AGENT, timeout: float = TIMEOUT_S) -> tuple[int | None, str | None, str | None, str | None]:
    """Status, text, encoding and the url at the end; no status if nothing answered."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
            text, name = read_text(answer.read(), answer.headers.get("Content-Type"))
            return answer.status, text, name, answer.url
    except urllib.error.HTTPError as answer:
        text, name = read_text(answer.read(), answer.headers.get("Content-Type"))
        return answer.code, text, name, url
    except (OSError, ValueError):
        return None, None, None, url


def tried(url: str | None, limiter: Limiter, agent: str = AGENT, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """Status, text, encoding, the url at the end, tries, waits and wait_ms of one page: tried again, with its host's turns and growing pauses, where that may help."""
    try:
        site = urlsplit(url or "").hostname or ""
    except ValueError:
        site = ""
    waits, wait_ms, turns = 0, 0, limiter.turns(site)
    for tries in range(1, RETRIES + 1):
        with turns.turn() as waited:
            waits, wait_ms = waits + (waited > 0), wait_ms + waited
            answer = get(url or "", agent)
        if answer[0] is not None and answer[0] not in AGAIN or tries == RETRIES:
            return *answer, tries, waits, wait_ms
        sleep(FIRST_DELAY_S * 2 ** (tries - 1))
    raise AssertionError("the last try returns")


def fetch(links: DataFrame, *columns: str, agent: str = AGENT, interval_s: float = INTERVAL_S, concurrent: int = CONCURRENT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """columns of links (url among them), status, html, encoding, final_url, tries, waits, wait_ms.

    A host's requests go through one task, `concurrent` of them at once, their starts interval_s apart; hosts of one task are fetched beside each other, so that
    no core sits out one host's pauses. A host is a queue by nature: more of them, not more tasks for one, make a fetch faster. Rows of a lost task are fetched again.
    """
    names = [c for c in columns if c != "url"]
    # within a task hosts come mixed, so that many of them are under way
    chosen = links.select(*names, "url").withColumn("_host", host(F.col("url"))).repartition("_host").sortWithinPartitions(F.xxhash64("url"), *names)
    kept = [f for f in chosen.schema.fields if f.name != "_host"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "status int, html string, encoding string, final_url string, tries int, waits int, wait_ms long"])
    made = [("status", pa.int32()), ("html", pa.string()), ("encoding", pa.string()), ("final_url", pa.string()), ("tries", pa.int32()), ("waits", pa.int32()), ("wait_ms", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = Limiter(interval_s, concurrent, sleep=sleep)
        jobs = ((batch.slice(i, 1), url) for batch in batches for i, url in enumerate(batch.column("url").to_pylist()))
        for own, answer in at_once(lambda job: (job[0], tried(job[1], limiter, agent, sleep)), jobs):
            yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(f.name)) for f in kept), *(pa.array([x], kind) for x, (_, kind) in zip(answer, made))], [*(f.name for f in kept), *(n for n, _ in made)])

    return chosen.mapInArrow(run, schema)


def with_totals(fetched: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """fetched, and its totals once it has been written: pages, requests, waits, wait_ms and failed. They are taken from the rows that came out, so a task that
    ran twice counts once. Of a stream, each progress report has the totals of its batch, while the stream goes on."""
    totals = Observation(name)
    sums = [F.count(F.lit(1)).alias("pages"), F.sum("tries").alias("requests"), F.sum("waits").alias("waits"), F.sum("wait_ms").alias("wait_ms"), F.count_if(~F.coalesce(F.col("status").between(200, 299), F.lit(False))).alias("failed")]
    return (fetched.observe(name, *sums), totals) if fetched.isStreaming else (fetched.observe(totals, *sums), totals)


def chapters(links: DataFrame, load: Callable[[DataFrame], DataFrame], key: str = "page_id", most: int = PAGES, selector: str | None = None) -> DataFrame:
    """key, title, content, n_pages: each link's page and the pages that go on with it, joined. load: from (key, url) to these and html.

    A round fetches one more page of every chapter that has one; it ends when none has, after `most` pages at the latest.
    """
    spark = links.sparkSession
    todo, parts = links.select(key, "url"), None
    for n in range(most):
        # a round's pages are used for their text and for what comes next, and must not be fetched twice
        got = P.extract(parsed(load(todo), key, "url", nodes=bool(selector)), key, selector)
        round_ = settled(got.join(todo, key).withColumn("_n", F.lit(n)), "web-round")
        parts = round_ if parts is None else parts.unionByName(round_)
        onward = absolute(F.col("url"), F.col("next_href"))
        todo = round_.filter("next_href is not null").select(key, F.col("url").alias("_from"), onward.alias("url")).filter("url is not null and url <> _from").select(key, "url")
        if n + 1 == most or todo.isEmpty():
            break
    if parts is None:
        return spark.createDataFrame([], f"{key} long, title string, content string, n_pages long")
    pages = F.array_sort(F.collect_list(F.struct("_n", "title", "content")))
    rows = parts.groupBy(key).agg(pages.alias("p"), F.count("*").alias("n_pages"))
    return rows.select(key, F.element_at("p", 1)["title"].alias("title"), F.array_join(F.filter(F.transform("p", lambda x: x["content"]), lambda c: c != ""), "\n\n").alias("content"), "n_pages")
