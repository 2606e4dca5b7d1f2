"""Operator 12: conversations repaired by the cheapest edits that give them the right order of roles.

Method: a conversation's rows and edits form a graph whose nodes are (rows taken, state of the grammar). Forward costs (from the start) and backward
costs (to the end) make an arc tight if forward + cost + backward is the least cost of all; the tight arcs are exactly those of cheapest repairs. From
the start on, the set of nodes that the letters so far lead to (the frontier) takes the least letter that any of its tight arcs has. Keep, Rerole and
Delete each take one row and Insert takes none, so that a frontier is a set of states behind the same row.

Rows go to ranges of (conversation, turn), sorted by Spark. A conversation that ends within its range is repaired as it streams by. The first and the
last one of a range may go on in another: their rows are set aside, each range's share being a segment, so that a conversation with a third of all
rows is as many segments as ranges. A segment's share of the costs is a min-plus matrix over the four states; matrices are chained over a
conversation's segments (as many as there are ranges at most) for the costs that enter each one, frontiers are chained the same way, and only then are a
segment's letters and rows written, in pieces. What no division can spare is the hash of a repaired conversation, which is taken piece by piece in order.

Grammar: states are what the last role was: 0 nothing, 1 a system row, 2 the user, 3 the assistant; 0 and 3 may end.

Letters from a state lead to one state each, so a frontier that began with one state stays one; sets are walked all the same.

Defined results: nulls in role and text are one space, in the damage's key too; a null conv_id is one conversation. Rows of one turn come in the order of the
MD5 of their `role:text` before damage. A conversation of no rows has zeros, no letters and an empty text. Rows that repeat are duplicates of the first.
Other columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import stage

STATES, ENDS, FAR = 4, (0, 3), 1 << 40
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: The role that each state asks for, and the state after it.
ASKED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
AFTER = {(0, "s"): 1, **{(s, role[0]): then for s, (role, then) in ASKED.items()}}
FINE_PAIRS = {"su", "ua", "au"}
SPACES = " \t\n\x0b\f\r"
#: Rows and bytes of a conversation that a task holds before it sets them aside; rows of a segment; rows and bytes of a piece of the result.
HELD_ROWS, HELD_BYTES, SEGMENT_ROWS, PIECE_ROWS, PIECE_BYTES = 8192, 1 << 24, 1 << 15, 2048, 1 << 19
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# A segment's graph ---------------------------------------------------------------------------------------------------------------------

#: A row's kind is the initial of its role (s, u, a or o for others), as a capital if it is truncated, or x if it must go.
KINDS = "suaoSUAOx"


def arcs(kind: str) -> list[tuple[str, int, int, int]]:
    """(letter, cost, state before, state after) of the edits that take a row."""
    found = [(DELETE, COST[DELETE], s, s) for s in range(STATES)]
    if kind != "x":
        initial, late = kind.lower(), int(kind.isupper())
        found += [(KEEP, COST[KEEP] + late, s, AFTER[s, initial]) for s in range(STATES) if (s, initial) in AFTER]
        found += [(REROLE, COST[REROLE] + late, s, ASKED[s][1]) for s in range(STATES)]
    return found


ARCS = {kind: arcs(kind) for kind in KINDS}
INSERTS = [(INSERT, COST[INSERT], s, then) for s, (_, then) in ASKED.items()]


def inserted(costs: list[int]) -> list[int]:
    """Forward costs with rows put in; two rounds reach all that can pay."""
    costs = list(costs)
    for _ in range(2):
        for _, cost, s, then in INSERTS:
            costs[then] = min(costs[then], costs[s] + cost)
    return costs


def inserted_back(costs: list[int]) -> list[int]:
    """Backward costs with rows put in."""
    costs = list(costs)
    for _ in range(2):
        for _, cost, s, then in INSERTS:
            costs[s] = min(costs[s], costs[then] + cost)
    return costs


START = [0, FAR, FAR, FAR]
FINISH = inserted_back([0 if s in ENDS else FAR for s in range(STATES)])


def forward(costs: list[int], kinds: str) -> list[list[int]]:
    """Before each row and at the end, the least cost from the start to each state. At the end nothing is put in yet."""
    found = []
    for kind in kinds:
        costs = inserted(costs)
        found.append(costs)
        then = [FAR] * STATES
        for _, cost, s, t in ARCS[kind]:
            if costs[s] + cost < then[t]:
                then[t] = costs[s] + cost
        costs = then
    return [*found, costs]


def backward(costs: list[int], kinds: str) -> list[list[int]]:
    """Before each row and at the end, the least cost from each state on. costs: those at the end, with what is put in there."""
    found = [costs]
    for kind in reversed(kinds):
        before = [FAR] * STATES
        for _, cost, s, t in ARCS[kind]:
            if costs[t] + cost < before[s]:
                before[s] = costs[t] + cost
        costs = inserted_back(before)
        found.append(costs)
    return found[::-1]


def walk(frontier: int, ahead: list[list[int]], behind: list[list[int]], kinds: str, best: int, ends: bool) -> tuple[list[str], int]:
    """Letters from a frontier (bits of states before the first row) on, a string for each row and one for the end, and the frontier behind the last row.

    Each step takes the least letter of the tight arcs that leave the frontier. Only a conversation's last segment (ends) has letters for the end.
    """
    letters, at = [], frontier
    for i, kind in enumerate([*kinds, None]):
        if kind is None and not ends:
            return [*letters, ""], at
        costs, written = ahead[i] if kind else inserted(ahead[i]), ""
        while True:
            if kind is None and any(at >> s & 1 and costs[s] == best for s in ENDS):
                return [*letters, written], at
            options: dict[str, int] = {}
            tight = [(x, t) for x, cost, s, t in INSERTS if at >> s & 1 and costs[s] + cost + behind[i][t] == best]
            if kind:
                tight += [(x, t) for x, cost, s, t in ARCS[kind] if at >> s & 1 and costs[s] + cost + behind[i + 1][t] == best]
            for letter, t in tight:
                options[letter] = options.get(letter, 0) | 1 << t
            letter = min(options)
            written, at = written + letter, options[letter]
            if letter != INSERT:
                break
        letters.append(written)
    raise AssertionError("the end is always reached")


def edited(state: int, written: str, row: tuple[str, str] | None) -> tuple[list[tuple[str, str]], int]:
    """What a row becomes by its letters, as rows (role, text), and the state after them."""
    out = []
    for letter in written:
        if letter != DELETE:
            role = row[0] if letter == KEEP else ASKED[state][0]
            out.append((role, "" if letter == INSERT else row[1]))
            state = AFTER[state, role[0]]
    return out, state


# Rows ------------------------------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with one row in five damaged, by crc32 of `conv_id:turn` modulo 20.

    0: live is false; 1: no text; 2: without [.!?]; 3: twice; 4: role user. _tie and _id order rows of one turn.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_kind"))
    rows = rows.withColumn("_tie", F.md5(F.concat("role", F.lit(":"), "text"))).withColumn("_id", F.monotonically_increasing_id())
    kind = F.col("_kind")
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind != 0).alias("live"), "_tie", "_id", copies.alias("_copy"))


def look(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it ends in the middle of a sentence."""
    bare = text.rstrip(SPACES)
    return not bare, bool(bare) and bare[-1] not in ".!?"


def initial_of(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "o"


def kind_of(initial: str, must_go: bool, truncated: bool) -> str:
    return "x" if must_go else initial.upper() if truncated else initial


def key_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{role}:{text}".encode(), digest_size=16).digest()


class Counted:
    """What is counted over a conversation's rows as they come in order."""

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.least = self.most = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        duplicate &= not blank
        truncated &= not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.illegal += bool(self.last) and self.last + initial not in FINE_PAIRS
        self.first, self.last = self.first or initial, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.kinds.append(kind_of(initial, blank or duplicate, truncated))

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def whole(rows: list[tuple]) -> tuple:
    """counts, letters and repaired rows of a conversation: rows are (turn, role, text) in order."""
    counted, seen = Counted(), set()
    for turn, role, text in rows:
        key = key_of(role, text)
        blank, truncated = look(text)
        counted.add(turn, initial_of(role), blank, key in seen, truncated)
        seen.add(key)
    kinds = "".join(counted.kinds)
    ahead, behind = forward(START, kinds), backward(FINISH, kinds)
    letters, _ = walk(1, ahead, behind, kinds, behind[0][0], True)
    repaired, state = [], 0
    for written, row in zip(letters, [*rows, None]):
        new, state = edited(state, written, row and row[1:])
        repaired += new
    return (counted.gaps(), counted.blank, counted.duplicate, counted.truncated, counted.illegal, behind[0][0]), "".join(letters), repaired


# Passes over ranges ----------------------------------------------------------------------------------------------------------------------

_LONGS, _ROLES = pa.list_(pa.int64()), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_TYPES = {"role": pa.string(), "text": pa.string(), "live": pa.bool_(), "blank_row": pa.bool_(), "open_row": pa.bool_(), "key": pa.binary(), "audit": pa.string(), "repaired": _ROLES, "repaired_sha256": pa.string(), "kinds": pa.string(), "first": pa.string(), "last": pa.string(), "ends": pa.bool_()}
_TYPES |= dict.fromkeys(("matrix", "ahead", "behind", "exits"), _LONGS)
_ASIDE = ["segment", "place", "turn", "role", "text", "live", "blank_row", "open_row", "key"]
_SUMS = ["segment", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns", "kinds", "matrix"]
_PLAN = ["segment", "kinds", "ahead", "behind", "ends", *COUNTS]
_PIECE = ["piece", *COUNTS, "audit", "repaired"]
_DDL = {pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", _LONGS: "array<long>", _ROLES: "array<struct<role: string, text: string>>"}


def _through(df: DataFrame, run: Callable, into: list[str]) -> DataFrame:
    """df through run(batches, write), to conv_id and the columns named; write makes a batch of tuples of them."""
    conv = df.schema["conv_id"].dataType.simpleString()

    def whole_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fields = pa.schema([("conv_id", first.schema.field("conv_id").type), *((c, _TYPES.get(c, pa.int64())) for c in into)])

        def write(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

        yield from run(itertools.chain([first], batches), write)

    return df.mapInArrow(whole_task, ", ".join([f"conv_id {conv}", *(f"`{c}` {_DDL.get(_TYPES.get(c), 'long')}" for c in into)]))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of columns in runs of one key, read batch by batch."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in [*key, *columns])))
    for found, run in itertools.groupby(rows, key=lambda r: r[: len(key)]):
        yield found, (r[len(key) :] for r in run)


def _sift(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range to results of the conversations that end within it, and the rows, as they are, of those that may not."""
    part = TaskContext.get().partitionId() << 33
    no_result, no_row = (None,) * len(_PIECE), (None,) * len(_ASIDE)
    out: list[tuple] = []

    def put(conv: object, held: list[tuple], aside: bool) -> None:
        if not aside:
            counts, letters, repaired = whole([r[1:4] for r in held if r[4]])
            out.append((conv, 0, *counts, letters, [{"role": r, "text": t} for r, t in repaired], *no_row))
            return
        for place, turn, role, text, live in held:
            out.append((conv, *no_result, place // SEGMENT_ROWS, place, turn, role, text, live, *look(text), key_of(role, text)))

    n, last, first = 0, None, True
    for (conv,), rows in _runs(batches, ["conv_id"], ["turn", "role", "text", "live"]):
        if last:
            put(*last)
        # the first conversation of a range may have begun in the one before, the last one may go on in the next
        aside, held, size = first, [], 0
        for row in rows:
            held.append((part | n, *row))
            size += len(row[2])
            n += 1
            if len(held) > HELD_ROWS or size > HELD_BYTES:
                aside = True
                put(conv, held, aside)
                held, size = [], 0
            if len(out) >= PIECE_ROWS:
                yield write(out)
                out.clear()
        last, first = (conv, held, aside), False
    if last:
        put(*last[:2], True)
    yield write(out)


def _summed(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """A row a segment: its counts, kinds and matrix."""
    for (conv, segment), rows in _runs(batches, ["conv_id", "segment"], ["turn", "role", "live", "blank_row", "open_row", "again"]):
        c = Counted()
        for turn, role, live, blank, open_, again in rows:
            if live:
                c.add(turn, initial_of(role), blank, again, open_)
        kinds = "".join(c.kinds)
        matrix = [x for s in range(STATES) for x in forward([0 if s == t else FAR for t in range(STATES)], kinds)[-1]]
        yield write([(conv, segment, c.blank, c.duplicate, c.truncated, c.illegal, c.first, c.last, c.least, c.most, c.turns, kinds, matrix)])


def _planned(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """A row a segment: the costs that enter it from both sides, and the counts of its conversation."""
    for (conv,), rows in _runs(batches, ["conv_id"], _SUMS):
        parts = [dict(zip(_SUMS, row)) for row in rows]
        matrices = [[p["matrix"][s * STATES : (s + 1) * STATES] for s in range(STATES)] for p in parts]
        ahead, behind = [START], [FINISH]
        for m in matrices:
            ahead.append([min(FAR, *(ahead[-1][s] + m[s][t] for s in range(STATES))) for t in range(STATES)])
        for m in reversed(matrices):
            behind.append([min(FAR, *(m[s][t] + behind[-1][t] for t in range(STATES))) for s in range(STATES)])
        behind.reverse()
        timed, spoken = [p for p in parts if p["turns"]], [p for p in parts if p["first"]]
        total = Counted()
        total.turns = sum(p["turns"] for p in parts) - sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:]))
        total.least, total.most = (timed[0]["least"], timed[-1]["most"]) if timed else (None, None)
        illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in FINE_PAIRS for a, b in zip(spoken, spoken[1:]))
        counts = (total.gaps(), *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, behind[0][0])
        yield write([(conv, p["segment"], p["kinds"], ahead[i], behind[i + 1], i + 1 == len(parts), *counts) for i, p in enumerate(parts)])


def _exits(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """For each segment, the frontier to which each state that a tight path enters it by leads; 0 for other states."""
    for (conv, segment), rows in _runs(batches, ["conv_id", "segment"], ["kinds", "ahead", "behind", "ends", "cost"]):
        for kinds, enters, leaves, ends, cost in rows:
            ahead, behind = forward(enters, kinds), backward(leaves, kinds)
            found = [walk(1 << s, ahead, behind, kinds, cost, ends)[1] if enters[s] + behind[0][s] == cost else 0 for s in range(STATES)]
            yield write([(conv, segment, found)])


def _entered(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """The state in which each segment of a conversation begins."""
    for (conv,), rows in _runs(batches, ["conv_id"], ["segment", "exits"]):
        state, out = 0, []
        for segment, exits in rows:
            out.append((conv, segment, state))
            state = exits[state].bit_length() - 1
        yield write(out)


def _written(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    """Pieces of repaired conversations. A segment's first row is its plan, then its rows come in order."""
    columns = ["place", "role", "text", "live", *_PLAN[1:], "state"]
    for (conv, segment), rows in _runs(batches, ["conv_id", "segment"], columns):
        _, _, _, _, kinds, enters, leaves, ends, *counts, state = next(rows)
        letters, _ = walk(1 << state, forward(enters, kinds), backward(leaves, kinds), kinds, counts[-1], ends)
        piece, at, audit, repaired, size = segment * SEGMENT_ROWS, 0, "", [], 0
        for place, role, text, *_ in (row for row in rows if row[3]):
            if at and (at % PIECE_ROWS == 0 or size > PIECE_BYTES):
                yield write([(conv, piece, *counts, audit, repaired)])
                piece, audit, repaired, size = place, "", [], 0
            more, state = edited(state, letters[at], (role, text))
            audit, size, at = audit + letters[at], size + len(text), at + 1
            repaired += [{"role": r, "text": t} for r, t in more]
        more, state = edited(state, letters[at], None)
        yield write([(conv, piece, *counts, audit + letters[at], repaired + [{"role": r, "text": t} for r, t in more])])


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations in pieces: conv_id, piece (they go in this order), alone (a conversation's only one), COUNTS (of the whole conversation,
    in each piece), audit (letters of the edits) and repaired (role, text).

    rows: as `damaged` gives them; any rows of conv_id, turn, role, text (none null), live, _tie, _id and _copy, by which rows of one turn are in order.
    """
    order = ["conv_id", "turn", "_tie", "_id", "_copy"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "live")
    sifted = stage(_through(ranges, _sift, [*_PIECE, *_ASIDE]), "repair-sifted")
    done = sifted.filter("place is null").select("conv_id", *_PIECE).withColumn("alone", F.lit(True))
    aside = sifted.filter("place is not null").select("conv_id", *_ASIDE)

    same = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    first = aside.filter("live").groupBy("conv_id", "key").agg(F.min("place").alias("_place")).select("_place")
    light = aside.drop("text", "key").join(first, F.col("place") == F.col("_place"), "left").withColumn("again", F.col("_place").isNull())
    by_segment = lambda df, *then: df.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", *then)
    by_conv = lambda df, *then: df.repartition("conv_id").sortWithinPartitions("conv_id", *then)
    sums = _through(by_segment(light, "place"), _summed, _SUMS)
    plan = stage(_through(by_conv(sums, "segment"), _planned, _PLAN), "repair-plan")
    exits = _through(by_segment(plan), _exits, ["segment", "exits"])
    state = _through(by_conv(exits, "segment"), _entered, ["segment", "state"]).select(F.col("conv_id").alias("_conv_id"), F.col("segment").alias("_segment"), "state")
    heads = plan.join(state, same("conv_id") & same("segment")).select("conv_id", *_PLAN, "state", F.lit(-1).cast("long").alias("place"))
    both = heads.unionByName(aside.select("conv_id", "segment", "place", "role", "text", "live"), allowMissingColumns=True)
    pieces = _through(by_segment(both, "place"), _written, _PIECE).withColumn("alone", F.lit(False))
    return done.unionByName(pieces).select("conv_id", "piece", "alone", *COUNTS, "audit", "repaired")


def _hashed(batches: Iterator[pa.RecordBatch], write: Callable) -> Iterator[pa.RecordBatch]:
    for (conv,), rows in _runs(batches, ["conv_id"], [*COUNTS, "audit", "repaired"]):
        sha, letters, any_ = hashlib.sha256(), [], False
        for *counts, audit, repaired in rows:
            letters.append(audit)
            for row in repaired:
                sha.update(("\n" if any_ else "").encode() + f"{row['role']}:{row['text']}".encode())
                any_ = True
        yield write([(conv, *counts, "".join(letters), sha.hexdigest())])


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, COUNTS, audit and repaired_sha256 (of the rows as `role:text`, joined by newlines) of each conversation, from its pieces."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    short = pieces.filter("alone").withColumn("repaired_sha256", F.sha2(text, 256)).select(*names)
    long_ = pieces.filter("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return short.unionByName(_through(long_, _hashed, [*COUNTS, "audit", "repaired_sha256"]))
