"""Fetch tasks: what is left to do, when each request may start, retries, progress and reports."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.functions.text import half_up
from quillflow.operators.folds import folded

FIRST_DELAY_MS, RETRIES = 800, 3
INTERVAL_MS, CONCURRENT = 3000, 2
OWN_INTERVAL_MS, OWN_CONCURRENT = 30, 6
RUNNING, PAUSED, CANCELLED, DONE = "running", "paused", "cancelled", "done"
# Reasons of failure as they are shown.
REASONS = {"ROBOTS_DISALLOWED": "robots.txt 禁止", "EMPTY_CONTENT": "抓到的内容是空的", "COMPLIANCE_REJECTED": "合规自检未通过", "fetch_failed": "网络或页面异常", "RETRY_EXHAUSTED": "连续重试都失败", "HTTP_404": "页面不存在"}
OTHER_REASON = "抓取失败"


def remaining(links: DataFrame, done: DataFrame) -> DataFrame:
    """Links (book_id, index) of a resumed task without chapters that are there."""
    return links.join(done.filter("is_ok").select("book_id", "index"), ["book_id", "index"], "left_anti")


def retry_links(links: DataFrame, failures: DataFrame) -> DataFrame:
    return links.join(failures.select("book_id", "index").distinct(), ["book_id", "index"], "left_semi")


def host_limits(host: Column) -> Column:
    """interval_ms and concurrent for a host: the usual ones, or those for the own machine."""
    bare = F.element_at(F.split(host, ":"), 1)
    own = bare.isin("localhost", "::1", "0.0.0.0") | F.startswith(bare, F.lit("127."))
    return F.struct(F.when(own, OWN_INTERVAL_MS).otherwise(INTERVAL_MS).alias("interval_ms"), F.when(own, OWN_CONCURRENT).otherwise(CONCURRENT).alias("concurrent"))


def paced(requests: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """requests (host, at_ms, request_id) with start_ms and wait_ms: starts of one host are interval_ms apart at least, in the order of arrival.

    start(k) = k * interval + the greatest at(j) - j * interval of j up to k, so a running maximum takes the place of a queue. A host's order is a
    queue by nature; its windows are a host's own. For requests that take longer than the interval see `scheduled`.
    """
    w = Window.partitionBy("host").orderBy("at_ms", "request_id")
    # an int's times the interval overflow beyond 715 000 requests of a host
    k = F.row_number().over(w).cast("long")
    rows = requests.withColumn("_k", k).withColumn("_slack", F.col("at_ms") - F.col("_k") * interval_ms)
    start = F.col("_k") * interval_ms + F.max("_slack").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_ms", start).withColumn("wait_ms", F.col("start_ms") - F.col("at_ms")).drop("_k", "_slack")


def scheduled(requests: DataFrame) -> DataFrame:
    """requests (host, at_ms, request_id, duration_ms) with start_ms and wait_ms under each host's limits: in the order of arrival, starts an
    interval apart at least, and no more under way at once than the host allows. A fold over a host's requests, of which it holds those under way."""
    limits = requests.withColumn("_limits", host_limits(F.col("host"))).withColumns({"_interval": F.col("_limits.interval_ms"), "_most": F.col("_limits.concurrent")}).drop("_limits")

    def start() -> Callable[[tuple], int]:
        ends: list[int] = []
        last: list[int] = []

        def place(row: tuple) -> int:
            at, duration, interval, most = row
            begin = max([at, *(x + interval for x in last)])
            if len(ends) >= most:
                begin = max(begin, heapq.heappop(ends))
            heapq.heappush(ends, begin + (duration or 0))
            last[:] = [begin]
            return begin

        return place

    rows = folded(limits, ["host"], ["at_ms", "request_id"], ["at_ms", "duration_ms", "_interval", "_most"], "start_ms", start)
    return rows.drop("_interval", "_most").withColumn("wait_ms", F.col("start_ms") - F.col("at_ms"))


def pacing_stats(started: DataFrame) -> DataFrame:
    return started.groupBy("host").agg(F.count("*").alias("requests"), F.count_if(F.col("wait_ms") > 0).alias("waits"), F.sum("wait_ms").alias("wait_ms"))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before the try after attempt (1 first): doubled each time; null when no try is left."""
    return F.when(attempt <= RETRIES, (FIRST_DELAY_MS * F.pow(F.lit(2), attempt - 1)).cast("long"))


def failure_histogram(failures: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return failures.groupBy("reason").agg(F.count("*").alias("n")).withColumn("label", F.coalesce(labels[F.col("reason")], F.lit(OTHER_REASON)))


def report(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A row a task: total, success, failed, skipped. outcomes: task_id, index, outcome (ok, failed, skipped); links: task_id, index."""
    both = links.join(outcomes, ["task_id", "index"], "left")
    rows = both.groupBy("task_id").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    return rows.withColumn("success", F.col("total") - F.col("failed") - F.col("skipped"))


def timing(tasks: DataFrame, now_ms: Column) -> DataFrame:
    """tasks (started_ms, finished_ms, done, failed, total) with elapsed_ms and eta_ms; failed ones count as done, and no rest is told at none or all."""
    elapsed = F.coalesce("finished_ms", now_ms) - F.col("started_ms")
    done = F.col("done") + F.col("failed")
    eta = F.when((done > 0) & (done < F.col("total")), half_up(elapsed / done * (F.col("total") - done)))
    return tasks.withColumns({"elapsed_ms": elapsed, "eta_ms": eta})


def task_counts(steps: DataFrame) -> DataFrame:
    """done, failed and total of each task from its steps (task_id, outcome; null while open)."""
    return steps.groupBy("task_id").agg(F.count_if(F.col("outcome") == "ok").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("total"))


def pruned(tasks: DataFrame, keep: int = 50) -> DataFrame:
    """Open tasks, and of the finished ones the newest."""
    finished = tasks.filter("finished_ms is not null").orderBy(F.col("finished_ms").desc(), "id").limit(keep)
    return tasks.filter("finished_ms is null").unionByName(finished)


def commanded(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """tasks (task_id, state and others) after commands (task_id, command, at, command_id): pause, resume or cancel, each task's in order of time.

    Only what runs can be paused, only what is paused can go on, and what is cancelled or done stays so; other commands change nothing. States follow from the last command before which
    none cancelled, so no order is folded: the earliest cancel decides, else the latest pause or resume.
    """
    last = commands.filter(F.col("command").isin("pause", "resume", "cancel")).groupBy("task_id").agg(F.count_if(F.col("command") == "cancel").alias("_cancels"), F.max_by("command", F.struct("at", "command_id")).alias("_last"))
    open_ = F.col("state").isin(RUNNING, PAUSED)
    state = F.when(~open_ | F.col("_last").isNull(), F.col("state")).when(F.col("_cancels") > 0, CANCELLED).when(F.col("_last") == "pause", PAUSED).otherwise(RUNNING)
    return tasks.join(last, "task_id", "left").withColumn("state", state).drop("_cancels", "_last").select(*tasks.columns)


def workable(links: DataFrame, tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Links (task_id, book_id, index) of running tasks whose chapters are not there yet: what a run, or one that goes on, has to fetch."""
    running = tasks.filter(F.col("state") == RUNNING).select("task_id")
    return remaining(links.join(running, "task_id", "left_semi"), done)
