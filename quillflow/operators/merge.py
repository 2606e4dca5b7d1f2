"""Merging a backup into a library, under the conflict modes skip, overwrite and coexist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP, OVERWRITE, COEXIST = MODES = ("skip", "overwrite", "coexist")
COPY_SUFFIX = "（导入）"


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")


def merge_books(local: DataFrame, remote: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The library after the merge (with `outcome`: kept, added, skipped, overwritten, coexisted), and the map old_id to new_id of the backup's books.

    A book that both have stays as it is (skip), is replaced (overwrite), or comes beside under another id and title (coexist).
    """
    _check(mode)
    ids = local.select("book_id", F.lit(True).alias("_here"))
    r = remote.join(ids, "book_id", "left")
    here = F.col("_here").isNotNull()
    new_id = F.when(here & (F.lit(mode) == COEXIST), F.substring(F.sha1(F.concat(F.lit("import::"), "book_id")), 1, 12)).otherwise(F.col("book_id"))
    r = r.withColumns({"old_id": F.col("book_id"), "_new": new_id})
    id_map = r.select("old_id", F.col("_new").alias("new_id"))
    outcome = F.when(~here, "added").otherwise({SKIP: "skipped", OVERWRITE: "overwritten", COEXIST: "coexisted"}[mode])
    title = F.when(here & (F.lit(mode) == COEXIST), F.concat("title", F.lit(COPY_SUFFIX))).otherwise(F.col("title"))
    incoming = r.withColumns({"outcome": outcome, "title": title, "book_id": F.col("_new")}).drop("old_id", "_new", "_here")
    mine = local.withColumn("outcome", F.lit("kept"))
    if mode == SKIP:
        taken = incoming.filter("outcome = 'skipped'").select("book_id", F.lit(True).alias("_s"))
        mine = mine.join(taken, "book_id", "left").withColumn("outcome", F.when(F.col("_s"), "skipped").otherwise("kept")).drop("_s")
        return mine.unionByName(incoming.filter("outcome = 'added'")), id_map
    if mode == OVERWRITE:
        mine = mine.join(incoming.select("book_id"), "book_id", "left_anti")
    return mine.unionByName(incoming), id_map


def remapped(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """Rows of the backup under their books' new ids; rows of unknown books go."""
    return rows.join(id_map.withColumnRenamed("old_id", "book_id"), "book_id").drop("book_id").withColumnRenamed("new_id", "book_id").select(*rows.columns)


def merge_progress(local: DataFrame, remote: DataFrame, mode: str) -> DataFrame:
    """A row a book: of two the local (skip), the remote (overwrite), or the newer one, the local at a tie (coexist)."""
    _check(mode)
    columns = [c for c in local.columns if c != "book_id"]
    l, r = (df.select("book_id", F.struct(*columns).alias(n)) for df, n in ((local, "l"), (remote, "r")))
    both = l.join(r, "book_id", "full")
    wins = {SKIP: F.lit(False), OVERWRITE: F.lit(True), COEXIST: F.coalesce(F.col("r.updated_at") > F.col("l.updated_at"), F.col("l.updated_at").isNull() & F.col("r.updated_at").isNotNull())}[mode]
    pick = F.when(F.col("l").isNull() | (F.col("r").isNotNull() & wins), F.col("r")).otherwise(F.col("l"))
    return both.select("book_id", pick.alias("p")).select("book_id", "p.*")


def merge_marks(local: DataFrame, remote: DataFrame, mode: str) -> DataFrame:
    """Bookmarks or notes: an id that both have is replaced only by overwrite; a new id at a place that is taken comes in unless the mode is skip.

    Among the remote's own rows the first of an id counts (the last when overwriting), and under skip the first of a place, in the order of created_at and id.
    """
    _check(mode)
    place = ["book_id", "chapter_index", "char_offset"]
    columns = local.columns
    order = F.struct("created_at", *[c for c in columns if c != "created_at"])
    best = F.max_by if mode == OVERWRITE else F.min_by
    fresh = remote.groupBy("id").agg(best(F.struct(*columns), order).alias("m")).select("m.*").select(*columns)
    added = fresh.join(local.select("id"), "id", "left_anti").select(*columns)
    if mode == SKIP:
        added = added.groupBy(*place).agg(F.min_by(F.struct(*columns), order).alias("m")).select("m.*").select(*columns)
        added = added.join(local.select(*place).distinct(), place, "left_anti").select(*columns)
    if mode == OVERWRITE:
        replaced = fresh.join(local.select("id"), "id", "left_semi").select(*columns)
        return local.join(replaced.select("id"), "id", "left_anti").select(*columns).unionByName(replaced).unionByName(added)
    return local.unionByName(added)


def merge_history(local: DataFrame, remote: DataFrame, most: int = 500) -> DataFrame:
    """All entries, newest first, repeats included, at most so many."""
    both = local.unionByName(remote)
    return both.orderBy(F.col("at").desc(), *[c for c in both.columns if c != "at"]).limit(most)


def merge_sessions(local: DataFrame, remote: DataFrame, most: int = 5000) -> DataFrame:
    """Local sessions and those remote ones (each once) whose book, start and length are not there yet, newest first, at most so many."""
    key = ["book_id", "started_at", "duration_ms"]
    new = remote.join(local.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    both = local.unionByName(new.select(*local.columns))
    return both.orderBy(F.col("started_at").desc(), *[c for c in both.columns if c != "started_at"]).limit(most)


def upsert(base: DataFrame, changes: DataFrame, key: str = "book_id") -> DataFrame:
    """base with the rows of changes in place of its own of the same key; chapters are counted and reading clipped where those columns are."""
    out = base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))
    if {"read_chapters", "total_chapters"} <= {*out.columns}:
        out = out.withColumn("read_chapters", F.least("read_chapters", "total_chapters"))
    return out


def create(base: DataFrame, new: DataFrame, on_exists: str = "return") -> DataFrame:
    """base with new books. One that exists stays (return), fails the query (error), or takes the new columns but title, chapters and creation (merge)."""
    if on_exists not in ("return", "merge", "error"):
        raise ValueError("on_exists must be return, merge or error")
    fresh = new.join(base.select("book_id"), "book_id", "left_anti")
    if on_exists == "error":
        clash = new.join(base.select("book_id"), "book_id", "left_semi").limit(1)
        if not clash.isEmpty():
            raise ValueError("a book of that id exists")
    if on_exists != "merge":
        return base.unionByName(fresh.select(*base.columns))
    kept = {"book_id", "title", "total_chapters", "created_at"}
    patch_columns = [c for c in base.columns if c not in kept]
    return patch(base, new.select("book_id", *patch_columns)).unionByName(fresh.select(*base.columns))


def patch(base: DataFrame, changes: DataFrame, key: str = "book_id") -> DataFrame:
    """base with the values of changes (the key and some of its columns) where they are not null."""
    named = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
    joined = base.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in base.columns])


def remove(books: DataFrame, gone: DataFrame, at=None) -> tuple[DataFrame, DataFrame]:
    """What is left of books, and the trash's new rows with the time of removal."""
    trash = books.join(gone, "book_id", "left_semi").withColumn("removed_at", F.current_timestamp() if at is None else at)
    return books.join(gone, "book_id", "left_anti"), trash


def outcome_totals(merged: DataFrame) -> DataFrame:
    """One row of what a merge did with the backup's books: added, skipped, overwritten, coexisted, and all of them."""
    names = ("added", "skipped", "overwritten", "coexisted")
    return merged.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names], F.count_if(F.col("outcome").isin(*names)).alias("total"))
