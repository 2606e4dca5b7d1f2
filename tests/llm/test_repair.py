import functools
import hashlib
import random
import zlib

import pytest

from quillflow.llm import repair

THEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damaged(rows):
    """(conv_id, turn, role, text) to {conv_id: [(turn, role, text)]} in order, by the words of the task."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        tie = hashlib.md5(f"{role}:{text}".encode()).hexdigest()
        out = convs.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [((turn is not None, turn or 0, tie), (turn, role, text))] * {0: 0, 3: 2}.get(kind, 1)
    return {c: [r for _, r in sorted(out, key=lambda x: x[0])] for c, out in convs.items()}


def brute(rows):
    """The result of one conversation by trying all edits, remembering the best rest from each place."""
    seen, facts, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        facts.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @functools.cache
    def rest(i, state, put=0):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        add = lambda cost, letter, line, then: options.append((then[0] + cost, letter + then[1], (line + then[2]) if line else then[2]))
        role, to = THEN[state]
        if put < 3:
            add(2, "I", (f"{role}:",), rest(i, to, put + 1))
        if i < len(rows):
            _, own, text = rows[i]
            add(3, "D", (), rest(i + 1, state))
            if facts[i] not in ("blank", "duplicate"):
                late = int(facts[i] == "truncated")
                add(2 + late, "R", (f"{role}:{text}",), rest(i + 1, to))
                if own[:1] == role[0]:
                    add(late, "K", (f"{own}:{text}",), rest(i + 1, to))
                if own[:1] == "s" and state == 0:
                    add(late, "K", (f"{own}:{text}",), rest(i + 1, 1))
        return min(options, default=(1 << 40, "", ()))

    cost, audit, lines = rest(0, 0)
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n, most):
    rng = random.Random(seed)
    texts = ["Hello there.", "Fine!", "what", "", " \n", "Is it?", "no end", "é. "]
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "ua"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, most)):
            at = None if rng.random() < 0.08 else turn + (rng.random() < 0.1) * rng.randint(-2, 3)
            rows.append((conv, at, rng.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], rng.choice([*texts, f"Unlike others {rng.random()}.", f"open {rng.random()}", None])))
    return rows


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, place int, kinds string, live boolean").repartition(parts)
    found = [tuple(r) for r in repair.digests(repair.repair(repair.damaged(df))).collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_repair_equals_all_edits(spark):
    rows = made(3, 220, 12)
    found, wanted = got(spark, rows), {c: brute(r) for c, r in damaged(rows).items()}
    assert set(found) == set(wanted)
    assert {c: (found[c], wanted[c]) for c in found if found[c] != wanted[c]} == {}


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, 0, "assistant", "Other."), (1, None, "system", "Rules."), (1, None, None, None)] * 3
    assert got(spark, rows)[1] == brute(damaged(rows)[1])


def test_a_conversation_of_no_rows_left(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert got(spark, [(5, turn, "user", "Gone.")])[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, []) == {}


def test_a_conversation_over_many_segments(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Some {i}.", f"open {i}", "No!"])) for i in range(70_000)]
    rows += [(c, i, "user", "Hi.") for c in (0, 2) for i in range(3)]
    found = got(spark, rows, 4)
    for conv, own in damaged(rows).items():
        counts, letters, repaired = repair.whole(own)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        assert found[conv] == (*counts, letters, sha)


@pytest.mark.parametrize("seed", range(6))
def test_segments_chain_to_the_whole(seed):
    rng = random.Random(seed)
    kinds = "".join(rng.choice(repair.KINDS) for _ in range(rng.randint(0, 40)))
    ahead, behind = repair.forward(repair.START, kinds), repair.backward(repair.FINISH, kinds)
    letters, _ = repair.walk(1, ahead, behind, kinds, behind[0][0], True)
    cut = rng.randint(0, len(kinds))
    before, after = kinds[:cut], kinds[cut:]
    rest = repair.backward(repair.FINISH, after)
    first, frontier = repair.walk(1, repair.forward(repair.START, before), repair.backward(rest[0], before), before, behind[0][0], False)
    second, _ = repair.walk(frontier, repair.forward(repair.forward(repair.START, before)[-1], after), rest, after, behind[0][0], True)
    assert first[:-1] + second == letters and frontier.bit_count() == 1
