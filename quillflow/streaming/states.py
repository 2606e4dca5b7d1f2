"""Streams that keep a state for each key: rows are taken in order of their time, and a state may live for so long only.

Rows come in any order, a batch at a time. Those of a key wait in the state store until the watermark has passed their time; a timer then takes them
in order of (time, order) through a fold. So the result hangs on neither batches nor restarts, and a row's cost on what waits for its key, not on
what has been before. Rows later than the watermark, and rows of no time or no key, are left out: they have no place in the order any more.
Times count in milliseconds here, as watermarks do.

Keys share groups, by their hash: what a key costs beyond its rows (frames, timers, messages between Spark and Python) is paid once for its group, and a key
reads and writes but its own state. A group's rows wait together.

A state with a time to live is dropped when the watermark passes its end (at most a 64th of its life later), whether or not its key is heard of again.
Keys of no state and no waiting rows take no room.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillflow.operators.reading import NEAR

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a host's robots rules, and a staged upload, are good for.
ROBOTS_S, STAGED_S = 600, 7200
#: Rows of a frame, and the order of a row that has none: before all others of its time.
FRAME, NO_ORDER = 10_000, -(2**63)
#: Groups that keys are hashed into, and the parts of a state's life to which its end is rounded up.
GROUPS, LIFE_PARTS = 1024, 64

#: (state or None, row) to (state or None, rows of the result).
Fold = Callable[[tuple | None, Row], tuple[tuple | None, list[tuple]]]


class InOrder(StatefulProcessor):
    """Rows of a key through a fold, in order. A state is a tuple whose first entry is the time, in milliseconds, at which its life begins.

    Waiting rows are kept in parts of some thousand, each a few arrays, and given in frames of as many: a task holds the times and orders of the waiting rows of one
    key, or of one group of keys (16 bytes each, 8 for its key, and its values where there are any), and a frame of what comes of them.
    """

    def __init__(self, fold: Fold, columns: list[str], waiting: str, state: str, output: list[str], live_ms: int | None):
        self.fold, self.columns, self.waiting_ddl, self.state_ddl, self.output, self.live_ms = fold, columns, waiting, state, output, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "part string", self.waiting_ddl)
        self.state = handle.getValueState("state", self.state_ddl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            frame = frame[frame["at_ms"] > passed]
            if len(frame):
                at = frame["at_ms"].to_numpy(np.int64)
                self._put(at, frame["order_of"].to_numpy(np.int64), frame["values_of"].tolist() if len(self.columns) > 2 else None, self._keys(frame))
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def _keys(self, frame: pd.DataFrame) -> pd.Series | None:
        """The rows' keys, where they have not one in common."""
        return None

    def _put(self, at: np.ndarray, order: np.ndarray, values: list[str] | None, keys: pd.Series | None) -> None:
        keyed = ()
        if keys is not None:
            codes, names = pd.factorize(keys, use_na_sentinel=False)
            keyed = (codes.astype(np.int32).tobytes(), names.tolist())
        self.waiting.updateValue((uuid.uuid4().hex,), (pickle.dumps((at.tobytes(), order.tobytes(), values, *keyed)),))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        at, order, which, values, taken, first, codes = [], [], [], [], [], None, {}
        for part, packed in self.waiting.iterator():
            times, orders, texts, *keyed = pickle.loads(packed[0])
            times = np.frombuffer(times, np.int64)
            if times.min() > passed:
                first = int(times.min()) if first is None else min(first, int(times.min()))
                continue
            taken.append(part)
            at.append(times)
            order.append(np.frombuffer(orders, np.int64))
            names = keyed[1] if keyed else key
            which.append(np.array([codes.setdefault(k, len(codes)) for k in names])[np.frombuffer(keyed[0], np.int32) if keyed else np.zeros(len(times), np.int32)])
            values += texts or []
        at, order, which = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, order, which))
        keys = list(codes)
        ready, later = np.flatnonzero(at <= passed), np.flatnonzero(at > passed)
        ready = ready[np.lexsort((order[ready], at[ready], which[ready]))]
        make, out, of, before, state = Row(*self.columns), [], None, None, None
        for start in range(0, len(ready), FRAME):
            places = ready[start : start + FRAME]
            for i, code, now, place in zip(places.tolist(), which[places].tolist(), at[places].tolist(), order[places].tolist()):
                if code != of:
                    if of is not None:
                        self._settle(keys[of], before, state, passed)
                    of, before = code, self._held(keys[code])
                    state = before
                if self._over(state, now):
                    state = None
                more = json.loads(values[i]).values() if values else ()
                state, found = self.fold(state, make(now, None if place == NO_ORDER else place, *more))
                out += [(keys[code], *each) for each in found]
            if len(out) >= FRAME:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        if of is not None:
            self._settle(keys[of], before, state, passed)
        if self.live_ms is not None:
            self._end(key, passed, expiredTimerInfo)
        if len(taken) == 1 and not len(later) and first is None:
            self.waiting.clear()
        else:
            for part in taken:
                self.waiting.removeKey(part)
        for start in range(0, len(later), FRAME):
            places = later[start : start + FRAME]
            self._put(at[places], order[places], [values[i] for i in places.tolist()] if values else None, self._again(keys, which[places]))
        if len(taken) and (len(later) or first is not None):
            self.handle.registerTimer(min([*([int(at[later].min())] if len(later) else []), *([first] if first is not None else [])]))

    def _again(self, keys: list, which: np.ndarray) -> pd.Series | None:
        """The keys of rows that wait on, as _keys has them."""
        return None

    def _settle(self, key, before: tuple | None, state: tuple | None, passed: int) -> None:
        """A key's state is kept as it is now, if it is still good."""
        if state is None or self._over(state, passed):
            if before is not None:
                self._drop(key)
        elif state != before:
            self._hold(key, state)

    def _held(self, key) -> tuple | None:
        state = self.state.get()
        return None if state is None else tuple(state)

    def _hold(self, key, state: tuple) -> None:
        self.state.update(state)
        if self.live_ms is not None:
            self.handle.registerTimer(state[0] + self.live_ms)

    def _drop(self, key) -> None:
        self.state.clear()

    def _end(self, key: tuple, passed: int, expired) -> None:
        """States whose life is over are dropped, also those of keys without rows."""
        state = self._held(key[0])
        self._settle(key[0], state, state, passed)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.output, dtype=object)

    def _over(self, state: tuple | None, now: int) -> bool:
        return state is not None and self.live_ms is not None and now - state[0] >= self.live_ms

    def close(self) -> None:
        pass


class InGroups(InOrder):
    """Rows of a group of keys through a fold, each key's in order, with a state for each key.

    Ends of states are kept by their time, rounded up, with the keys that they are of: a timer reads those alone.
    """

    def __init__(self, key: str, key_ddl: str, *rest):
        super().__init__(*rest)
        self.key, self.key_ddl = key, key_ddl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ending = handle, {}
        self.waiting = handle.getMapState("waiting", "part string", self.waiting_ddl)
        self.state = handle.getMapState("state", self.key_ddl, self.state_ddl)
        self.ends = handle.getMapState("ends", "at_ms long", "keys binary")

    def _keys(self, frame: pd.DataFrame) -> pd.Series:
        return frame[self.key]

    def _again(self, keys: list, which: np.ndarray) -> pd.Series:
        return pd.Series(keys).iloc[which]

    def _held(self, key) -> tuple | None:
        state = self.state.getValue((key,))
        return None if state is None else tuple(state)

    def _hold(self, key, state: tuple) -> None:
        self.state.updateValue((key,), state)
        if self.live_ms is not None:
            step = max(1, self.live_ms // LIFE_PARTS)
            self.ending.setdefault(-(-(state[0] + self.live_ms) // step) * step, []).append(key)

    def _drop(self, key) -> None:
        self.state.removeKey((key,))

    def _end(self, key: tuple, passed: int, expired) -> None:
        at = expired.getExpiryTimeInMs()
        packed = self.ends.getValue((at,))
        if packed is not None:
            for name in pickle.loads(packed[0]):
                state = self._held(name)
                self._settle(name, state, state, passed)
            self.ends.removeKey((at,))
        for end, names in self.ending.items():
            packed = self.ends.getValue((end,))
            self.ends.updateValue((end,), (pickle.dumps(list(dict.fromkeys([*(pickle.loads(packed[0]) if packed is not None else []), *names]))),))
            self.handle.registerTimer(end)
        self.ending = {}


def in_order(stream: DataFrame, key: str, at: str, order: str, values: list[str], fold: Fold, state: str, output: str, late: str, live_s: int | None = None, groups: int = GROUPS) -> DataFrame:
    """key and output (columns as DDL) of stream's rows through the fold.

    at: a timestamp; order: a long that orders rows of one time; the fold's rows have at_ms, order and values. state: DDL, its first column a long. values: columns that JSON can hold (texts, numbers, booleans).
    groups: how many groups keys are hashed into; a stream's checkpoint goes on with the same number only.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = stream.filter(F.col(at).isNotNull() & F.col(key).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    # a row's values are one text, in which nulls and whole numbers stay what they are
    packed = F.to_json(F.struct(*values), {"ignoreNullFields": "false"}) if values else F.lit(None).cast("string")
    # frames take no names that begin with an underscore
    rows = timed.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group_of"), key, at, F.unix_millis(at).alias("at_ms"), F.coalesce(F.col(order).cast("long"), F.lit(NO_ORDER)).alias("order_of"), packed.alias("values_of"))
    columns = ["at_ms", "_order", *values]
    key_ddl = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    result = f"{key_ddl}, {output}"
    names = spark.createDataFrame([], result).columns
    processor = InGroups(key, key_ddl, fold, columns, "rows binary", state, names, None if live_s is None else live_s * 1000)
    return rows.groupBy("group_of").transformWithStateInPandas(statefulProcessor=processor, outputStructType=result, outputMode="append", timeMode="eventTime")


def kept_jumps(jumps: DataFrame, reader: str = "owner_id", near: int = NEAR, late: str = "1 hour") -> DataFrame:
    """reader, book_id, chapter_index, char_offset, at_ms, event_id of jumps that are kept: all but those to about where the reader's last kept one led.

    jumps: reader, book_id, chapter_index, char_offset, at, event_id. The state of a reader is the last jump that was kept.
    """

    def fold(head: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        if head is not None and head[1:3] == (row.book_id, row.chapter_index) and abs(head[3] - row.char_offset) < near:
            return head, []
        found = (row.book_id, row.chapter_index, row.char_offset)
        return (row.at_ms, *found), [(*found, row.at_ms, row["_order"])]

    columns = "book_id string, chapter_index int, char_offset int"
    rows = jumps.withColumn("char_offset", F.coalesce("char_offset", F.lit(0)))
    return in_order(rows, reader, "at", "event_id", ["book_id", "chapter_index", "char_offset"], fold, f"since long, {columns}", f"{columns}, at_ms long, event_id long", late)


def robots_fetches(requests: DataFrame, late: str = "1 minute", live_s: int = ROBOTS_S) -> DataFrame:
    """host, request_id, at_ms, fetch, rules_at_ms of requests (host, at, request_id): whether each one has to fetch its host's rules, and when those that it
    goes by were fetched. Rules are good for live_s seconds and dropped then."""

    def fold(rules: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        now = rules or (row.at_ms,)
        return now, [(row["_order"], row.at_ms, rules is None, now[0])]

    return in_order(requests, "host", "at", "request_id", [], fold, "since long", "request_id long, at_ms long, fetch boolean, rules_at_ms long", late, live_s)


def staged_uploads(events: DataFrame, late: str = "1 minute", live_s: int = STAGED_S) -> DataFrame:
    """upload_id, event_id, at_ms, found of events that ask for a staged upload; others (is_upload) stage it, anew if it is there.

    events: upload_id, at, event_id, is_upload. An upload is there for live_s seconds and dropped then.
    """

    def fold(staged: tuple | None, row: Row) -> tuple[tuple | None, list[tuple]]:
        return ((row.at_ms,), []) if row.is_upload else (staged, [(row["_order"], row.at_ms, staged is not None)])

    return in_order(events, "upload_id", "at", "event_id", ["is_upload"], fold, "since long", "event_id long, at_ms long, found boolean", late, live_s)


def batch_files(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink of one folder a batch below folder: a batch that is sent again replaces its own rows."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")


def in_state(spark: SparkSession, checkpoint: str, state: str) -> DataFrame:
    """What a query's checkpoint holds of a state (`waiting` or `state`), by Spark's own reader of state."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", state).load()
