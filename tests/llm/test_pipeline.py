"""The pipeline's stages on a small folder of tables, against plain versions of each."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_llm import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels, benchmark: toxic ones, copies, near copies, leaks, nulls."""
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(n, prose(rng, 30)) for n in range(6)]
    texts, toxic, leaked = [], set(), set()
    for i in range(240):
        w = prose(rng, 70).split()
        if i % 4 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["blarg", "gronkish", "snivel"]))
            toxic.add(i)
        elif i % 29 == 5:
            w[20:20] = rng.choice(items)[1].split()
            leaked.add(i)
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], texts[2] + " more", "", None, "short text"]
    docs = [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "a row without an id", "en", "s0", 1)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int", "labels")
    write(items, "item_id long, text string", "benchmark")
    return path, docs, toxic, leaked


def test_stages(spark, tables):
    path, docs, toxic, leaked = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    clean = stages["toxicity"](spark, now, path)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and toxic - left == toxic and len(left) == len(docs) - len(toxic)
    single = stages["near_duplicates"](spark, clean, path)
    want = set(brute.similar_components([(d[0], d[1]) for d in docs if d[0] is not None and d[0] in left]).values()) | {None}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    fresh = stages["decontamination"](spark, single, path)
    assert fresh.columns == columns and {r.doc_id for r in fresh.collect()} == want - leaked
    mixed = stages["mixing"](spark, fresh, path)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= want - leaked
    final = stages["sharding"](spark, mixed, path)
    assert final.count() == mixed.count() and final.agg(F.max("shard")).first()[0] < 24


def test_run_and_empty_tables(spark, tables, tmp_path):
    path = tables[0]
    assert corpus_pipeline.run(spark, path).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
