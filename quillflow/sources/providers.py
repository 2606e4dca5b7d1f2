"""Where pages come from: providers that know an address, read its table of contents and its chapters, and the source `pages` that Spark reads by name.

A provider is asked in order whether it can handle an address; the first that can reads it. Another source of books is another Provider in the list;
tasks, reports and the rest stay as they are.
"""

from __future__ import annotations

import io
import json
import time
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quillflow.functions.html import parsed
from quillflow.functions.urls import host
from quillflow.operators import pages as P
from quillflow.sources import web
from quillflow.sources.limits import Limiter, at_once


def _parsed(pages: DataFrame, key: str, selectors: dict[str, str | None]) -> DataFrame:
    return parsed(pages, key, "url", nodes=any(selectors.values()))


class Provider(ABC):
    """What a source of books has to do. Pages are rows of key, url and html; selectors of one's own are toc, link and content."""

    name: str
    label: str

    @abstractmethod
    def can_handle(self, url: Column) -> Column: ...

    @abstractmethod
    def probe(self, pages: DataFrame, key: str, **selectors: str | None) -> DataFrame:
        """A row a page: whether it is a table of contents, of what book, and its chapters' links."""

    @abstractmethod
    def extract(self, pages: DataFrame, key: str, **selectors: str | None) -> DataFrame:
        """A row a page: the chapter's title and content, and the page that goes on with it."""

    def load(self, links: DataFrame, *columns: str) -> DataFrame:
        """Pages of links (columns, url)."""
        return web.fetch(links, *columns)

    def preview(self, pages: DataFrame, key: str = "page_id", count: int = 3, **selectors: str | None) -> DataFrame:
        """key, index, url, title, content of the first chapters of each table of contents."""
        links = P.toc_links(_parsed(pages, key, selectors), key, selector=selectors.get("toc"), link_selector=selectors.get("link")).filter(F.col("index") <= count)
        got = self.load(links.select(F.concat_ws(":", F.col(key).cast("string"), "index").alias("_id"), key, "index", "url"), "_id", key, "index", "url")
        texts = self.extract(got, "_id", **selectors)
        return got.select("_id", key, "index", "url").join(texts.select("_id", "title", "content"), "_id").drop("_id")


class GenericWeb(Provider):
    """Any page of the web, by its structure alone."""

    name, label = "generic-web", "Web pages"

    def can_handle(self, url: Column) -> Column:
        return F.coalesce(F.lower(url).rlike("^https?://[^/]"), F.lit(False))

    def probe(self, pages: DataFrame, key: str = "page_id", **selectors: str | None) -> DataFrame:
        return P.probe(_parsed(pages, key, selectors), key, selector=selectors.get("toc"), link_selector=selectors.get("link"))

    def extract(self, pages: DataFrame, key: str = "page_id", **selectors: str | None) -> DataFrame:
        return P.extract(_parsed(pages, key, selectors), key, selectors.get("content"))


PROVIDERS: list[Provider] = [GenericWeb()]


def provider_of(url: Column, providers: Sequence[Provider] | None = None) -> Column:
    """The name of the first provider that can handle url; null if none can."""
    return F.coalesce(*[F.when(p.can_handle(url), F.lit(p.name)) for p in providers or PROVIDERS], F.lit(None).cast("string"))


def probed(pages: DataFrame, key: str = "page_id", providers: Sequence[Provider] | None = None, **selectors: str | None) -> DataFrame:
    """provider, and what the provider of each page's address makes of it; pages that none can handle have ok false and the reason no_provider."""
    providers = providers or PROVIDERS
    routed = pages.withColumn("_provider", provider_of(F.col("url"), providers))
    each = [p.probe(routed.filter(F.col("_provider") == p.name), key, **selectors).withColumn("provider", F.lit(p.name)) for p in providers]
    nobody = routed.filter(F.col("_provider").isNull()).select(key, F.lit(False).alias("ok"), F.lit("no_provider").alias("reason"))
    rows = nobody
    for found in each:
        rows = rows.unionByName(found, allowMissingColumns=True)
    return rows


# Pages as a source of Spark's -----------------------------------------------------------------------------------------------------------------

COLUMNS = "url string, host string, status int, html string, encoding string, final_url string, tries int, waits int, wait_ms long"
BUCKETS = 64


def write_links(links: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Adds links (url) to a folder that the source reads, as a generation of its own: files by bucket of hosts, so that a host's links are never in two partitions."""
    of = host(F.col("url"))
    rows = links.select("url", of.alias("host"), F.pmod(F.xxhash64(of), F.lit(buckets)).alias("bucket")).filter("url is not null")
    rows.repartition("bucket").write.partitionBy("bucket").json(f"{folder}/generation={time.time_ns():020d}")


@dataclass
class Links(InputPartition):
    """Files of one bucket of hosts, and the hosts that are wanted (none: all)."""

    files: list[str] = field(default_factory=list)
    hosts: list[str] | None = None


class _Pages:
    """Reads the pages of a partition's links. Only the columns asked for are made; where neither status nor what is read from the page is among them, nothing is fetched."""

    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.types = {"status": pa.int32(), "tries": pa.int32(), "waits": pa.int32(), "wait_ms": pa.int64()}
        self.folder = options["path"]
        self.agent = options.get("agent", web.AGENT)
        self.interval, self.concurrent = float(options.get("intervalSeconds", web.INTERVAL_S)), int(options.get("concurrent", web.CONCURRENT))
        self.hosts: list[str] | None = None

    def files(self, after: int = 0, upto: int = 1 << 70) -> list[list[str]]:
        """The files of each bucket in complete generations after one and up to another; no links are read for it."""
        found: dict[str, list[str]] = {}
        for generation in (g for g in self.generations() if after < g <= upto):
            for info in self._listed(f"/generation={generation:020d}", True):
                if info.is_file and info.base_name.startswith("part-"):
                    found.setdefault(info.path.rsplit("/", 2)[-2], []).append(info.path)
        return [sorted(files) for _, files in sorted(found.items())]

    def generations(self) -> list[int]:
        names = [i.path.rsplit("generation=", 1)[-1] for i in self._listed("", True) if i.base_name == "_SUCCESS"]
        return sorted(int(n.split("/")[0]) for n in names)

    def _listed(self, below: str, recursive: bool) -> list[fs.FileInfo]:
        where, path = fs.FileSystem.from_uri(self.folder)
        return where.get_file_info(fs.FileSelector(path + below, recursive=recursive, allow_not_found=True))

    def read(self, partition: Links) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.folder)
        limiter = Limiter(self.interval, self.concurrent)
        asked = set(self.names) - {"url", "host"}

        def links() -> Iterator[dict]:
            for name in partition.files:
                with where.open_input_stream(name) as lines:
                    for line in io.TextIOWrapper(io.BufferedReader(lines), "utf-8"):
                        row = json.loads(line)
                        if partition.hosts is None or row.get("host") in partition.hosts:
                            yield row

        def page(row: dict) -> dict:
            if asked:
                row |= dict(zip(("status", "html", "encoding", "final_url", "tries", "waits", "wait_ms"), web.tried(row["url"], limiter, self.agent)))
            return row

        for row in at_once(page, links()):
            yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], self.types.get(n, pa.string())) for n in self.names], self.names)


class _Reader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters of hosts are kept by the source, so that other hosts are not asked."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("host",):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.hosts = wanted if self.hosts is None else [h for h in self.hosts if h in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Links(files, self.hosts) for files in self.files()] or [Links()]


class _StreamReader(_Pages, DataSourceStreamReader):
    """Generations of links that come later are fetched later; an offset is the last one that has been read."""

    def initialOffset(self) -> dict:
        return {"generation": 0}

    def latestOffset(self) -> dict:
        return {"generation": max(self.generations(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Links(files) for files in self.files(start["generation"], end["generation"])]

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """`spark.read.format("pages")`: the pages behind the links of a folder (see write_links). Options: path, agent, intervalSeconds, concurrent.

    A schema of fewer columns makes only those. Partitions are buckets of hosts; a host's limits hold within its partition.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes `pages` known to the session, and lets it take filters of hosts."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
