"""Streams with a state for each key: whatever the batches, restarts and order of arrival, the result is that of the whole in order."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from quillflow.operators import reading
from quillflow.streaming import reading as streams
from quillflow.streaming import states

JUMPS = "owner_id string, book_id string, chapter_index int, char_offset int, at timestamp, event_id int"
T0 = datetime(2024, 1, 1)


class Feed:
    """Files that come one by one, and what a stream makes of them over several runs."""

    def __init__(self, spark, path, schema, build):
        self.spark, self.path, self.schema, self.build, self.n = spark, path, schema, build, 0

    def put(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
            self.n += 1

    def drain(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.path}/in")
        query = streams.drain(self.build(stream), states.batch_files(f"{self.path}/out"), f"{self.path}/checkpoint")
        query.awaitTermination(120)
        assert query.exception() is None
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.path}/out").collect()

    def held(self, name):
        return states.in_state(self.spark, f"{self.path}/checkpoint", name).count()


def test_history_over_restarts_equals_the_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = {u: [(u, "1", rng.randint(1, 2), rng.randrange(200), T0 + timedelta(minutes=i), i) for i in range(60)] for u in "ab"}
    mixed = [r for u in rows for r in rows[u]]
    mixed.sort(key=lambda r: r[4] + timedelta(minutes=rng.randrange(9)))  # out of order, within what may be late
    feed = Feed(spark, tmp_path, JUMPS, lambda s: states.kept_jumps(s, late="10 minutes"))
    feed.put(mixed[:40], mixed[40:70])
    first = feed.drain()
    feed.put(mixed[70:], [("z", "9", 1, 1, T0 + timedelta(days=30), 999)])
    got = feed.drain()
    assert 0 < len(first) < len(got)
    for u in rows:
        want = reading.push_history(spark.createDataFrame(rows[u], JUMPS)).collect()
        assert sorted(r.event_id for r in got if r.owner_id == u) == sorted(r.event_id for r in want)
    # a head for each reader whose rows have been taken; nobody's rows wait but those at the end
    assert feed.held("state") == 2 or feed.held("state") == 3


def test_late_and_timeless_jumps_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, JUMPS, lambda s: states.kept_jumps(s, late="0 seconds"))
    feed.put([("u", "1", 1, 0, T0 + timedelta(hours=1), 1), ("u", "1", 1, 0, None, 2), (None, "1", 1, 0, T0, 3), ("u", "2", None, None, T0, 4)])
    assert [(r.event_id, r.char_offset) for r in sorted(feed.drain(), key=lambda r: r.at_ms)] == [(4, 0), (1, 0)]
    feed.put([("u", "7", 1, 0, T0, 5), ("u", "7", 1, 0, T0 + timedelta(hours=2), 6)])
    assert {r.event_id for r in feed.drain()} == {1, 4, 6}


def test_rules_expire_and_are_fetched_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, "host string, at timestamp, request_id int", lambda s: states.robots_fetches(s, late="0 seconds"))
    at = lambda s: T0 + timedelta(seconds=s)
    feed.put([("a", at(599), 2), ("a", at(0), 1), ("b", at(10), 3)])
    feed.put([("a", at(600), 4), ("a", at(700), 5)])
    got = {r.request_id: r.fetch for r in feed.drain()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert feed.held("state") == 1  # b's rules are over, though nobody has asked for them again
    feed.put([("c", at(5000), 6)])
    feed.drain()
    assert feed.held("state") == 1 and feed.held("waiting") == 0


def test_staged_uploads_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, "upload_id string, at timestamp, event_id int, is_upload boolean", lambda s: states.staged_uploads(s, late="0 seconds"))
    at = lambda s: T0 + timedelta(seconds=s)
    feed.put([("a", at(0), 1, True), ("a", at(7199), 2, False), ("b", at(5), 3, False)], [("a", at(7200), 4, False), ("a", at(7300), 5, True)], [("a", at(9000), 6, False), ("a", at(99_000), 7, False)])
    assert {r.event_id: r.found for r in feed.drain()} == {2: True, 3: False, 4: False, 6: True, 7: False}
    assert feed.held("state") == 0


@pytest.mark.parametrize("live", [None, 1000])
def test_fold_of_one_key(live):
    p = states.InOrder(None, [], "", "", [], live)
    assert not p._over(None, 5) and p._over((0,), 1000) == bool(live) and not p._over((1,), 1000)


class Kept:
    """The states of one key, as a processor sees them."""

    def __init__(self):
        self.parts, self.value, self.timers = {}, None, []

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Kept()

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.passed

    def updateValue(self, part, rows):
        self.parts[part] = rows

    def removeKey(self, part):
        del self.parts[part]

    def iterator(self):
        return iter(list(self.parts.items()))

    def clear(self):
        self.parts = {}

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_key_of_many_rows_is_kept_in_parts_and_given_in_frames():
    n, kept = 25_000, Kept()
    p = states.InOrder(lambda state, r: ((r.at_ms,), [(r["_order"], r.at_ms)]), ["at_ms", "_order"], "rows binary", "since long", ["host", "request_id", "at_ms"], None)
    p.init(kept)
    times = random.Random(3).sample(range(n), n)
    frames = [pd.DataFrame({"host": "h", "at_ms": times[i : i + 10_000], "order_of": [t % 7 for t in times[i : i + 10_000]], "values_of": None}) for i in range(0, n, 10_000)]
    kept.passed = -1
    assert not list(p.handleInputRows(("h",), iter(frames), kept)) and len(kept.parts) == 3 and kept.timers == [0]
    kept.passed = 19_999
    first = list(p.handleExpiredTimer(("h",), kept, None))
    assert [len(x) for x in first] == [states.FRAME] * 2 and kept.timers[-1] == 20_000
    kept.passed = n
    rest = list(p.handleExpiredTimer(("h",), kept, None))
    assert [t for x in first + rest for t in x["at_ms"]] == list(range(n)) and not kept.parts


def test_rows_of_no_order_come_first_at_their_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, JUMPS, lambda s: states.kept_jumps(s, late="0 seconds"))
    feed.put([("u", "2", 1, 0, T0, 7), ("u", None, None, 3, T0, None)])
    assert [(r.event_id, r.book_id, r.chapter_index, r.char_offset) for r in sorted(feed.drain(), key=lambda r: r.event_id or 0)] == [(None, None, None, 3), (7, "2", 1, 0)]


def test_many_keys_wait_in_groups_not_each_by_itself(spark, tmp_path):
    n = 2_000
    feed = Feed(spark, tmp_path, JUMPS, lambda s: states.kept_jumps(s, late="10 minutes"))
    feed.put([(f"u{i}", "1", 1, 0, T0 + timedelta(seconds=i % 60), i) for i in range(n)])
    assert not feed.drain()
    assert 0 < feed.held("waiting") <= 1024
    feed.put([("z", "9", 1, 1, T0 + timedelta(days=1), n)])
    got = feed.drain()
    assert sorted((r.event_id, r.owner_id) for r in got) == [(i, f"u{i}") for i in range(n)]
    assert feed.held("state") == n and feed.held("waiting") == 1


@pytest.mark.parametrize("groups, kind, of", [(1, "long", lambda k: k - 4), (3, "date", lambda k: T0.date() + timedelta(days=k)), (2, "timestamp", lambda k: T0 + timedelta(hours=k))])
def test_keys_of_a_group_have_states_and_ends_of_their_own(spark, tmp_path, groups, kind, of):
    rng = random.Random(9)
    rows = [(of(rng.randrange(12)), rng.randrange(40_000), i) for i in range(400)]
    rows.sort(key=lambda r: r[1] + rng.randrange(600))  # out of order, within what may be late

    def fold(state, row):
        now = (row.at_ms, 0) if state is None else (state[0], state[1] + 1)
        return now, [(row["_order"], now[0], now[1])]

    def build(stream):
        return states.in_order(stream, "k", "at", "n", [], fold, "since long, seen int", "n long, since long, seen int", "600 seconds", 900, groups)

    feed = Feed(spark, tmp_path, f"k {kind}, at timestamp, n int", build)
    last = (of(7), 45_000, 400)
    put = [(k, T0 + timedelta(seconds=s), n) for k, s, n in [*rows, last]]
    feed.put(put[:150], put[150:250])
    feed.drain()
    feed.put(put[250:400], put[400:])
    got = {r.n: (r.k, r.since, r.seen) for r in feed.drain()}
    zero, want, head = int(T0.timestamp() * 1000), {}, {}
    for k, s, n in sorted(rows, key=lambda r: r[1:]):
        since, seen = head.get(k, (s, -1))
        head[k] = (s, 0) if s - since >= 900 else (since, seen + 1)
        want[n] = (k, head[k][0], head[k][1])
    offset = min(v[1] for v in got.values()) - min(v[1] for v in want.values()) * 1000
    assert abs(offset - zero) <= 14 * 3_600_000 and got == {n: (k, since * 1000 + offset, seen) for n, (k, since, seen) in want.items()}
    assert feed.held("state") == 0 and feed.held("ends") == 0 and feed.held("waiting") == 1


def test_ends_are_rounded_up_and_a_state_begun_anew_outlives_its_first_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, "upload_id string, at timestamp, event_id int, is_upload boolean", lambda s: states.staged_uploads(s, late="0 seconds"))
    at = lambda s: T0 + timedelta(seconds=s)
    feed.put([("a", at(0), 1, True)], [("a", at(5000), 2, True)], [("b", at(7200 + 7200 // 64 + 1), 3, False)])
    feed.drain()
    assert feed.held("state") == 1 and feed.held("ends") == 1
    feed.put([("a", at(12_199), 4, False), ("a", at(12_200), 5, False)])
    assert {r.event_id: r.found for r in feed.drain()} == {3: False, 4: True, 5: False}
