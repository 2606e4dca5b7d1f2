import http.server
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillflow.operators import fetching
from quillflow.sources import limits, providers, web

PAGES = {
    "/1": '<h1>第一章</h1><div id="content"><p>第一页的正文，足够长，超过四十个字符，好让它被认作正文的容器而不是导航栏目的一部分内容。</p></div><a href="/1_2">下一页</a>',
    "/1_2": '<h1>第一章</h1><div id="content"><p>第二页的正文，足够长，超过四十个字符，好让它被认作正文的容器而不是导航栏目的一部分内容。</p></div><a href="/2">下一章</a>',
}


PAGES["/book/"] = "<title>测试小说_测试作者_本站</title><div class='nav'><a href='/'>首页</a></div><ul id='list'>" + "".join(f"<li><a href='/{i}'>第{i}章 测试标题{i}</a></li>" for i in range(1, 13)) + "</ul>"


class Site(http.server.BaseHTTPRequestHandler):
    hits: list[str] = []
    starts: dict[str, list[float]] = {}
    under_way, most = {}, {}
    lock = threading.Lock()

    def do_GET(self):
        self.hits.append(self.path)
        if self.path.startswith("/slow"):
            host = self.headers["Host"]
            with self.lock:
                self.starts.setdefault(host, []).append(time.monotonic())
                self.under_way[host] = self.under_way.get(host, 0) + 1
                self.most[host] = max(self.most.get(host, 0), self.under_way[host])
            time.sleep(0.5)
            with self.lock:
                self.under_way[host] -= 1
        if self.path == "/500":
            self.send_response(500)
        elif self.path in PAGES or self.path == "/gbk":
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=gbk" if self.path == "/gbk" else "text/html; charset=utf-8")
        else:
            self.send_response(404)
        self.end_headers()
        self.wfile.write("中文页面".encode("gbk") if self.path == "/gbk" else PAGES.get(self.path, "").encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("0.0.0.0", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    df = spark.createDataFrame([(1, f"{site}/1"), (2, f"{site}/gbk"), (3, f"{site}/none"), (4, f"{site}/500"), (5, "http://127.0.0.1:1/"), (6, None)], "page_id long, url string")
    got = {r.page_id: r for r in web.fetch(df, "page_id", "url", sleep=lambda _: None).collect()}
    assert {k: r.status for k, r in got.items()} == {1: 200, 2: 200, 3: 404, 4: 500, 5: None, 6: None}
    assert got[2].html == "中文页面" and got[2].encoding == "gbk" and got[4].tries == 3 and got[3].tries == 1


def test_chapters_over_pages(spark, site):
    df = spark.createDataFrame([(1, f"{site}/1"), (2, f"{site}/none")], "page_id long, url string")
    got = {r.page_id: r for r in web.chapters(df, lambda links: web.fetch(links, "page_id", "url", sleep=lambda _: None)).collect()}
    assert got[1].n_pages == 2 and got[1].title == "第一章" and got[1].content.index("第一页") < got[1].content.index("第二页")
    assert got[2].content == ""


def slow_links(spark, hosts, n):
    return spark.createDataFrame([(i, f"http://{h}/slow{i}") for h in hosts for i in range(n)], "page_id long, url string")


def test_own_machine_has_six_at_once(spark, site):
    own = site.removeprefix("http://")
    fetched, totals = web.with_totals(web.fetch(slow_links(spark, [own], 12), "page_id", "url"))
    assert fetched.count() == 12
    starts = sorted(Site.starts[own])
    assert 2 <= Site.most[own] <= 6 and starts[-1] - starts[0] > 11 * 0.03 * 0.9
    got = totals.get
    assert got["requests"] == 12 and got["pages"] == 12 and got["failed"] == 12 and 0 < got["waits"] <= 11 and got["wait_ms"] > 0


def test_two_of_another_host_at_once(spark, site):
    name, port = socket.gethostname(), site.rsplit(":", 1)[1]
    try:
        socket.create_connection((name, int(port)), 2).close()
    except OSError:
        pytest.skip("the machine's name leads nowhere")
    own = site.removeprefix("http://")
    Site.most.clear()
    web.fetch(slow_links(spark, [f"{name}:{port}", own], 6), "page_id", "url", interval_s=0.2).count()
    starts = sorted(Site.starts[f"{name}:{port}"])
    assert Site.most[f"{name}:{port}"] == 2 and starts[-1] - starts[0] > 5 * 0.2 * 0.9
    assert starts[-1] - starts[0] < 6 * 0.5  # serial requests would take that


def test_limiter_by_a_clock_of_its_own():
    now, slept = [100.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    limiter = limits.Limiter(clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        with limiter.turns("example.com").turn():
            pass
    with limiter.turns("other.com").turn() as waited:
        assert waited == 0
    t = limiter.turns("example.com")
    assert slept == [3.0, 3.0] and (t.requests, t.waits, t.wait_ms) == (3, 2, 6000)
    assert limiter.turns("127.0.0.1").interval == 0.03 and limiter.turns("::1").slots._value == 6 and t.slots._value == 2


def test_at_once_reads_jobs_as_they_are_worked_off():
    taken = []
    jobs = (taken.append(i) or i for i in range(100))
    out = limits.at_once(lambda x: x * 2, jobs, 4)
    next(out)
    assert len(taken) <= 5 and sorted([*out]) != [] and len(taken) == 100


def test_pages_by_name(spark, site, tmp_path):
    providers.register(spark)
    links = spark.createDataFrame([(f"{site}/1",), (f"{site}/none",), ("http://127.0.0.1:1/x",), (None,)], "url string")
    providers.write_links(links, f"{tmp_path}/links", 4)
    df = spark.read.format("pages").load(f"{tmp_path}/links")
    got = {r.url: r.status for r in df.collect()}
    assert got == {f"{site}/1": 200, f"{site}/none": 404, "http://127.0.0.1:1/x": None}
    Site.hits.clear()
    only = spark.read.format("pages").schema("url string, status int, host string").load(f"{tmp_path}/links")
    assert only.columns == ["url", "status", "host"]
    assert [r.status for r in only.filter(F.col("host") == "127.0.0.1:1").collect()] == [None] and Site.hits == []
    assert spark.read.format("pages").schema("url string").load(f"{tmp_path}/links").count() == 3 and Site.hits == []
    assert spark.read.format("pages").load(f"{tmp_path}/nothing").collect() == []


def test_pages_as_a_stream(spark, site, tmp_path):
    providers.register(spark)
    put = lambda *names: providers.write_links(spark.createDataFrame([(f"{site}/{n}",) for n in names], "url string"), f"{tmp_path}/links", 4)

    def drain():
        stream, _ = web.with_totals(spark.readStream.format("pages").load(f"{tmp_path}/links"), "totals")
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        q.awaitTermination(60)
        assert q.exception() is None
        return [p.observedMetrics["totals"].requests for p in q.recentProgress if p.numInputRows]

    put("1", "none")
    assert sum(drain()) == 2
    put("1_2")
    assert sum(drain()) == 1
    assert sorted(r.url.rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "1_2", "none"]


class Archive(providers.Provider):
    name, label = "archive", "An archive of its own"

    def can_handle(self, url):
        return F.coalesce(url.startswith("archive:"), F.lit(False))

    def probe(self, pages, key, **selectors):
        return pages.select(key, F.lit(True).alias("ok"), F.lit("of the archive").alias("title"))

    def extract(self, pages, key, **selectors):
        return pages.select(key, F.lit("t").alias("title"), F.col("html").alias("content"))


def test_providers(spark, site):
    html = PAGES["/book/"]
    df = spark.createDataFrame([(1, f"{site}/book/", html), (2, "archive:7", html), (3, "ftp://x/y", html), (4, None, html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in providers.probed(df, providers=[Archive(), *providers.PROVIDERS]).collect()}
    assert {k: (r.provider, r.ok) for k, r in got.items()} == {1: ("generic-web", True), 2: ("archive", True), 3: (None, False), 4: (None, False)}
    one = got[1]
    assert one.title == "测试小说" and one.author == "测试作者" and one.site == site.removeprefix("http://") and one.n_links == 12
    assert one["sample"][0].title == "第1章 测试标题1" and one["sample"][0].url == f"{site}/1" and got[3].reason == "no_provider"
    first = providers.GenericWeb().preview(df.filter("page_id = 1"), count=1).collect()
    assert [(r["index"], r.title) for r in first] == [(1, "第一章")] and "第一页的正文" in first[0].content


def test_unknown_commands_change_nothing(spark):
    tasks = spark.createDataFrame([("t", fetching.PAUSED), ("u", fetching.PAUSED)], "task_id string, state string")
    commands = spark.createDataFrame([("t", "oops", 2, 1), ("u", "resume", 1, 2), ("u", None, 3, 3)], "task_id string, command string, at int, command_id int")
    assert {r.task_id: r.state for r in fetching.commanded(tasks, commands).collect()} == {"t": "paused", "u": "running"}
