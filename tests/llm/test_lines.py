import random

from quillflow.llm import lines

SCHEMA = "doc_id long, text string, runs string, _id long, hash int"


def brute(rows, least, documents):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\f\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
            if len(key) >= least:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        parts, kept = (text or "").split("\n"), []
        for line in parts:
            key = line.strip(" \t\n\x0b\f\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
            found = holders.get(key, set())
            last = max((d for d in found if d is not None), default=None)
            if not (len(found) >= documents and (doc is None or doc < last)):
                kept.append(line)
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


def both(spark, rows, least=40, documents=5):
    df = spark.createDataFrame([(d, t, "x", d, 1) for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in lines.without_shared_lines(df, least, documents).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(got, key=order) == sorted(brute(rows, least, documents), key=order)
    return {r[0]: r for r in got}


def test_lines_equal_a_slow_loop(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "dé lta", "EPS"]) for _ in range(rng.randint(2, 14))) for _ in range(60)]
    hot = "  Every document has this line of boilerplate, about cookies\t"
    rows = []
    for i in range(400):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        body += [hot.upper() if i % 2 else hot] * rng.choice([0, 1, 3])
        rng.shuffle(body)
        rows.append((i if i % 9 else None, "\n".join(body)))
    rows += [rows[3], rows[3], (7, "again " + hot), (3, hot), (1011, None), (1012, ""), (1013, "\n\n"), (1014, "x" * 50 + "\r"), (15, "line\n" * 30_000 + hot)]
    got = both(spark, rows)
    assert got[1012][1:] == (1, 0, "") and got[1013][1] == 3


def test_limits(spark):
    forty, short = "é" * 40, "é" * 39
    rows = [(i, f"{forty}\n{short}\n{forty}") for i in range(4)]
    assert all(r[2] == 0 for r in both(spark, rows).values())
    rows.append((9, f" {forty}\t\nend"))
    got = both(spark, rows)
    assert got[0][2] == 2 and got[0][3] == short and got[9][2] == 0
    # four documents that repeat a line, and one of no id that is the fifth and never the last
    got = both(spark, [*rows[:4], (None, forty)])
    assert got[3][2] == 0 and got[None][2] == 1
    assert both(spark, [(None, forty)] * 6)[None][2] == 0


def test_empty_table(spark):
    assert lines.without_shared_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bitmaps(spark):
    hot = "a line that is long enough to be looked at, by far"
    df = spark.createDataFrame([(i, f"one\ntwo\n{hot}\nthree\n{hot}") for i in range(6)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.keep_bitmaps(df).collect()}
    assert set(got) == set(range(5)) and got[0].n_dropped == 2
    assert [tuple(r) for r in got[0].runs] == [(0, 2), (3, 1), (5, None)]


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = lines.without_shared_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
