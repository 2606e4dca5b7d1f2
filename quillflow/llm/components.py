"""Connected components of links that are too many for one machine: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import lightly, stage, unused


def roots(links: DataFrame, name: str) -> DataFrame:
    """links (a, b): a row (node, root) for each node with a link to another; root is the least node of its component.

    Each round takes every node's neighbours to the least of them; minima are pre-aggregated, so that a node with most of the links is no
    hot group. It ends when no round changes a link.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: larger neighbours of u go to the least one around u
        large = edges.join(least, edges.b == least.u).select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        large = stage(large, f"{name}-large")
        # small star: u's smaller neighbours, and u, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stage(small, f"{name}-small")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def one_row_of_each(docs: DataFrame, class_: str, judged: DataFrame) -> DataFrame:
    """docs (doc_id, text and others, with a column of each row's class) with one row of each component.

    judged: doc_id, class and root of each row. The row of a component's least doc_id stays (a null id counts last), of several classes under
    that id the least one, of several rows of that class the one of the least text.
    """
    by_id = judged.groupBy("root", "class", "doc_id").count()
    first = by_id.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("stays"))
    marked = stage(by_id.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("class") == F.col("stays.class"))), "one-marked")
    id_, of, key = (unused(docs, c) for c in ("_id", "_of", "_key"))
    meets = lambda: F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(class_) == F.col(of))
    named = lambda rows: lightly(rows.select(F.col("doc_id").alias(id_), F.col("class").alias(of)))
    gone, again = marked.filter("not stays"), marked.filter("stays and count > 1")
    kept = docs.join(named(gone), meets(), "left_anti")
    if again.isEmpty():
        return kept
    single = kept.join(named(again), meets(), "left_anti")
    rows = kept.join(named(again), meets(), "left_semi").withColumn(key, F.coalesce("text", F.lit("")))
    least = rows.groupBy("doc_id", class_).agg(F.min_by(F.struct(*docs.columns), key).alias(key))
    return single.unionByName(least.select(F.col(f"{key}.*")))
