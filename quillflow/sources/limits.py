"""Pacing of requests within a task: so many of a host under way at once, their starts an interval apart."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from typing import TypeVar

from quillflow.operators.fetching import CONCURRENT, INTERVAL_MS, OWN_CONCURRENT, OWN_INTERVAL_MS

#: Requests of all hosts that one task has under way or waiting for their turn.
THREADS = 32
A, B = TypeVar("A"), TypeVar("B")


def is_own(host: str) -> bool:
    """Whether a host (without port) is the machine itself."""
    return host in ("localhost", "::1", "0.0.0.0") or host.startswith("127.")


class Turns:
    """The turns of one host: a counter of slots, and the time before which the next request may not start."""

    def __init__(self, interval: float, concurrent: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.slots, self.lock, self.next_start = threading.Semaphore(concurrent), threading.Lock(), 0.0
        self.requests, self.waits, self.wait_ms = 0, 0, 0

    @contextmanager
    def turn(self) -> Iterator[int]:
        """A turn, once it has come; gives the milliseconds for which its start was put off, other than for a slot."""
        with self.slots:
            with self.lock:
                now = self.clock()
                start = max(now, self.next_start)
                self.next_start = start + self.interval
                waited = round((start - now) * 1000)
                self.requests, self.waits, self.wait_ms = self.requests + 1, self.waits + (waited > 0), self.wait_ms + waited
            if start > now:
                self.sleep(start - now)
            yield waited


class Limiter:
    """Turns for each host of a task. A host is in one task, so its limits hold for the whole job."""

    def __init__(self, interval: float = INTERVAL_MS / 1000, concurrent: int = CONCURRENT, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.concurrent, self.clock, self.sleep = interval, concurrent, clock, sleep
        self.hosts: dict[str, Turns] = {}
        self.lock = threading.Lock()

    def turns(self, host: str) -> Turns:
        own = is_own(host)
        with self.lock:
            if host not in self.hosts:
                interval = min(self.interval, OWN_INTERVAL_MS / 1000) if own else self.interval
                self.hosts[host] = Turns(interval, OWN_CONCURRENT if own else self.concurrent, self.clock, self.sleep)
            return self.hosts[host]


def at_once(work: Callable[[A], B], jobs: Iterator[A], threads: int = THREADS) -> Iterator[B]:
    """work(job) of each job as it is done, with so many in hand at a time: jobs are read no faster than they are worked off."""
    with ThreadPoolExecutor(threads) as pool:
        open_: set[Future] = set()
        for job in jobs:
            open_.add(pool.submit(work, job))
            if len(open_) >= threads:
                done, open_ = wait(open_, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in done)
        yield from (f.result() for f in open_)
