"""The corpus pipeline: documents without toxic ones, near duplicates and benchmark passages, mixed to weights and sharded by bytes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Rows without a doc_id go through every stage as they are judged by their text; what a stage defines for nulls,
empty texts and repeated rows its operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillflow.llm import decontamination, mixing, sharding, similar
from quillflow.llm.common import stage
from quillflow.llm.queries import table, toxic_grammar
from quillflow.llm.toxicity import without_toxic
from quillflow.sources.shared import made, remove

SHARDS = 24


def without_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score 0.5 or more go."""
    return without_toxic(docs, toxic_grammar(spark, docs, sf_dir), 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component of near duplicates (similarity 0.8 of shingles of five words) the document of least id stays."""
    return similar.one_of_each(docs, words=5, similarity=0.8)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a benchmark item, within a fifth of its words of edits, go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), similarity=0.8)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources to weights 3, 1, 2 in turn and 150 % of all words; a document comes as often as the mix takes it."""
    return mixing.repeat_mixed(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: each row's shard of near-equal bytes and its slot there."""
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [("toxicity", without_toxic_documents), ("near_duplicates", without_near_duplicates), ("decontamination", without_benchmark), ("mixing", mixed_to_weights), ("sharding", sharded)]

#: Learned grammars, fingerprints, edit distances and differencing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it. What a stage wrote on the way is removed once it has been read."""
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for name, step in STAGES[:-1]:
        result = step(spark, docs, sf_dir)
        own = [path for path in made(spark) if path not in before]
        docs = stage(result, f"pipeline-{name}")
        remove(spark, own)
    return STAGES[-1][1](spark, docs, sf_dir)
