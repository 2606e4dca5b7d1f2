"""Queries of shelf, reading and merging over the star schema, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.operators import dedupe, merge, reading, schedule, shelf
from quillflow.plans import entities as E
from quillflow.schemas import ALL_PILE, FINISHED, FOLLOWING, READING, UNREAD

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NOW = "2024-01-17 12:00:00"
LATEST_SQL = f"{E.POSITIONS_SQL}, latest as (select * from positions qualify row_number() over (partition by book_id order by updated_at desc, event_id desc) = 1)"
DECORATED_SQL = f"""{E.BOOKS_SQL}, {LATEST_SQL}, decorated as (
  select b.*, p.chapter_index as pos_chapter_index, p.updated_at as pos_updated_at, greatest(new_channel, 0) as update_badge,
    case when p.book_id is null then case when total_chapters > 0 then least(1.0, least(read_raw, total_chapters) / cast(total_chapters as double)) else 0.0 end
      when total_chapters > 0 then greatest(p.percent, least(1.0, (p.chapter_index - 1 + p.chapter_ratio) / total_chapters)) else p.percent end as pct,
    coalesce(last_read_at, b.updated_at) as key_at
  from (select *, new_chapters as new_channel from books) b left join latest p on b.book_id = p.book_id)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.latest(E.positions(spark, sf_dir), "event_id")


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.decorate(E.books(spark, sf_dir), _latest(spark, sf_dir))


@query(f"with {E.SESSIONS_SQL} select day, cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions group by day")
def reading_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.totals(E.sessions(spark, sf_dir), "day")


@query(f"with {E.SESSIONS_SQL} select book_id, cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions group by book_id")
def reading_by_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.totals(E.sessions(spark, sf_dir), "book_id")


@query(f"with {E.SESSIONS_SQL} select strftime(date_trunc('week', started_at), '%Y-%m-%d') as week, cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions group by 1")
def reading_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.totals(E.sessions(spark, sf_dir), "week")


@query(f"with {E.SESSIONS_SQL} select cast(coalesce(sum(duration_ms), 0) as bigint) as ms, count(*) as n_sessions from sessions where day between '2024-01-15' and '2024-01-17'")
def reading_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.week_total(E.sessions(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query(f"with {E.SESSIONS_SQL} select cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions where book_id = '7' and day >= '2024-01-05' and day <= '2024-01-20'")
def reading_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.totals(reading.in_range(E.sessions(spark, sf_dir), "7", "2024-01-05", "2024-01-20"))


@query(f"""with {E.SESSIONS_SQL} select case when g = 1 then 'day' when g = 2 then 'book' else 'all' end as level, day, book_id, ms, n_sessions from (
  select day, book_id, grouping(day, book_id) as g, cast(sum(duration_ms) as bigint) as ms, count(*) as n_sessions from sessions group by grouping sets ((day), (book_id), ()))""")
def reading_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.overview(E.sessions(spark, sf_dir))


@query(f"with {LATEST_SQL} select book_id, chapter_index, char_offset, chapter_ratio, percent, updated_at, event_id from latest")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


@query(f"with {LATEST_SQL} select book_id, chapter_index, updated_at from latest order by updated_at desc, book_id limit 20")
def recent_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.recent(_latest(spark, sf_dir), 20).select("book_id", "chapter_index", "updated_at")


@query(f"""with {DECORATED_SQL} select book_id, title, author, status, round(pct, 3) as progress_percent, update_badge, pos_chapter_index, cast(epoch_us(key_at) // 1000 as bigint) as shelf_key from decorated""")
def shelf_decorate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.ordered(_decorated(spark, sf_dir)).select("book_id", "title", "author", "status", "progress_percent", "update_badge", "pos_chapter_index", "shelf_key")


@query(f"""with {DECORATED_SQL} select pile, count(*) as n_books from (
  select '{READING}' as pile from decorated where status = '{READING}' union all select '{FOLLOWING}' from decorated where status = '{FOLLOWING}' or update_badge > 0
  union all select '{FINISHED}' from decorated where status = '{FINISHED}' union all select '{ALL_PILE}' from decorated) group by pile""")
def pile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.pile_counts(_decorated(spark, sf_dir))


@query(f"with {E.BOOKS_SQL} select book_id, title, author from books where status = '{FINISHED}' and tag1 = 'BUILDING' and source_site = 'CHINA' and contains(lower(title), 'order 1')"
       .replace("'CHINA'", "(select min(n_name) from nation)"))
def filter_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = E.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return shelf.filtered(E.books(spark, sf_dir), status=FINISHED, tag="BUILDING", site=site, q=" ORDER 1 ").select("book_id", "title", "author")


@query(f"with {E.BOOKS_SQL} select distinct facet, value from (select 'tag' as facet, tag1 as value from books union all select 'tag', tag2 from books union all select 'site', source_site from books "
       "union all select 'author', author from books union all select 'status', status from books) where value is not null and value <> ''")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.facets(E.books(spark, sf_dir))


@query(f"""with {E.BOOKS_SQL} select count(*) as n_books, cast(sum(total_chapters) as bigint) as chapters, cast(sum(least(read_raw, total_chapters)) as bigint) as read, count_if(status = '{READING}') as n_reading,
  count_if(status = '{FOLLOWING}') as n_following, count_if(status = '{FINISHED}') as n_finished, count_if(status = '{UNREAD}') as n_unread, count(last_read_at) as n_with_reading from books""")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.library_stats(E.books(spark, sf_dir))


@query(f"""with {DECORATED_SQL}, {E.CHAPTERS_SQL}, top as (select * from decorated where pos_chapter_index is not null order by epoch_us(key_at) // 1000 desc, book_id limit 1)
  select t.book_id, t.title, t.pos_chapter_index as chapter_index, coalesce(c.title, '') as chapter_title, '第 ' || t.pos_chapter_index || ' 章' || coalesce(' · ' || c.title, '') as label,
    coalesce(t.last_read_at, t.pos_updated_at) as last_read_at, round(t.pct, 3) as percent, '/reader.html?book=' || t.book_id || '&ch=' || t.pos_chapter_index as reader_url
  from top t left join chapters c on c.book_id = t.book_id and c.idx = t.pos_chapter_index""")
def continue_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelf.continue_reading(_decorated(spark, sf_dir), E.chapters(spark, sf_dir))


@query(f"""with {E.BOOKS_SQL}, {LATEST_SQL}, {E.CHAPTERS_SQL}, j as (select b.book_id, b.total_chapters as total, p.chapter_index as ci, p.char_offset as o, p.chapter_ratio as r, p.percent as pc, coalesce(c.char_count, 0) as len
    from books b left join latest p on b.book_id = p.book_id left join chapters c on c.book_id = b.book_id and c.idx = p.chapter_index),
  m as (select *, case when ci is null then 'fresh' when total <= 0 then 'empty' when ci > total then 'by-percent' when len > 0 and (o > len or (o = 0 and r > 0)) then 'by-ratio' else 'exact' end as mode from j),
  x as (select *, case mode when 'exact' then greatest(o, 0) when 'by-ratio' then cast(floor(r * len + 0.5) as integer) else 0 end as off from m)
  select book_id, cast(case when mode in ('fresh', 'empty') then 1 when mode = 'by-percent' then least(total, greatest(1, cast(ceil(pc * total) as integer))) else ci end as integer) as chapter_index,
    cast(off as integer) as char_offset, case when mode in ('fresh', 'empty') then null when mode = 'by-percent' then r when len > 0 then least(1.0, off / cast(len as double)) else r end as chapter_ratio, mode from x""")
def resolve_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.resolve(E.books(spark, sf_dir), _latest(spark, sf_dir), E.chapters(spark, sf_dir))


@query(f"""with {E.BOOKS_SQL}, {LATEST_SQL}, j as (select b.*, least(read_raw, total_chapters) as was, p.chapter_index as ci, p.updated_at as seen_at from books b left join latest p on b.book_id = p.book_id),
  r as (select *, case when ci is null then was else greatest(was, ci) end as rd from j)
  select book_id, cast(least(rd, total_chapters) as integer) as read_chapters, case when ci is not null then seen_at else last_read_at end as last_read_at,
    case when ci is null then status when total_chapters > 0 and rd >= total_chapters then '{FINISHED}' when status in ('{UNREAD}', '{FINISHED}') then '{READING}' else status end as status from r""")
def sync_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.sync_books(E.books(spark, sf_dir), _latest(spark, sf_dir)).select("book_id", "read_chapters", "last_read_at", "status")


@query(f"with {E.BOOKS_SQL} select book_id, check_mode, next_check_at from books where toc_url is not null and check_mode <> 'manual' and (next_check_at is null or next_check_at <= timestamp '1997-06-01 00:00:00')")
def due_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.due(E.books(spark, sf_dir), F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")).select("book_id", "check_mode", "next_check_at")


@query("""select cast(user_id as varchar) as book_id, event_type as type, event_id as id, ts as "at" from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1
  order by "at" desc, book_id, type limit 200""")
def keep_latest_notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("book_id"), F.col("event_type").alias("type"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return schedule.latest_notices(e, 200, "id")


@query(f"""with {E.POSITIONS_SQL} select book_id, chapter_index, updated_at, event_id from positions
  qualify row_number() over (partition by book_id, epoch_us(updated_at) // 2000000 order by updated_at desc, event_id desc) = 1""")
def throttled_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.throttle(E.positions(spark, sf_dir)).select("book_id", "chapter_index", "updated_at", "event_id")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = E.table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.concat(F.lit("m"), i.cast("string")).alias("id"), F.col("user_id").cast("string").alias("book_id"), (i % 3 + 1).cast("int").alias("chapter_index"), (i * 7 % 60).cast("int").alias("char_offset"),
        F.col("event_type").alias("selected_text"), F.col("ts").alias("created_at"),
    )


MARKS_SQL = "marks as (select 'm' || event_id as id, cast(user_id as varchar) as book_id, cast(event_id % 3 + 1 as integer) as chapter_index, cast(event_id * 7 % 60 as integer) as char_offset, event_type as selected_text, ts as created_at from events)"


@query(f"""with recursive {MARKS_SQL}, m as (select *, row_number() over (partition by book_id, chapter_index, selected_text order by created_at, id) as k from marks),
  walk as (select *, true as stays, [char_offset] as taken from m where k = 1 union all
    select m.*, len(list_filter(w.taken, lambda x: abs(x - m.char_offset) <= 1)) = 0, case when len(list_filter(w.taken, lambda x: abs(x - m.char_offset) <= 1)) = 0 then list_append(w.taken, m.char_offset) else w.taken end
    from walk w join m on m.book_id = w.book_id and m.chapter_index = w.chapter_index and m.selected_text = w.selected_text and m.k = w.k + 1)
  select id, book_id, chapter_index, char_offset, selected_text, created_at from walk where stays""")
def bookmark_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.distinct_bookmarks(_marks(spark, sf_dir))


@query("""with recursive e as (select cast(event_id // 40 as varchar) as book_id, cast(event_id // 8 % 5 + 1 as integer) as chapter_index, cast(event_id * 13 % 90 as integer) as char_offset, ts, event_id from events),
  s as (select *, case when lag(book_id) over w = book_id and lag(chapter_index) over w = chapter_index then 0 else 1 end as starts from e window w as (order by ts, event_id)),
  g as (select *, sum(starts) over (order by ts, event_id) as stretch from s), m as (select *, row_number() over (partition by stretch order by ts, event_id) as k from g),
  walk as (select *, true as stays, char_offset as last from m where k = 1 union all
    select m.*, abs(m.char_offset - w.last) >= 40, case when abs(m.char_offset - w.last) >= 40 then m.char_offset else w.last end from walk w join m on m.stretch = w.stretch and m.k = w.k + 1)
  select book_id, chapter_index, char_offset, ts as "at", event_id from walk where stays""")
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events")
    entries = e.select(F.floor(F.col("event_id") / 40).cast("string").alias("book_id"), (F.floor(F.col("event_id") / 8) % 5 + 1).cast("int").alias("chapter_index"), (F.col("event_id") * 13 % 90).cast("int").alias("char_offset"), F.col("ts").alias("at"), "event_id")
    return reading.push_history(entries)


@query(f"""with {E.POSITIONS_SQL}, h as (select row_number() over (order by updated_at desc, event_id desc) - 1 as place, book_id, chapter_index, char_offset from positions order by place limit 500),
  c as (select distinct book_id, cast(book_id as integer) % 20 as cursor from h)
  select h.book_id, place, chapter_index, char_offset from h join c on h.book_id = c.book_id where place > cursor qualify row_number() over (partition by h.book_id order by place) = 1""")
def history_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a history is the newest 500 entries, so one window over them is bounded
    newest = reading.newest(E.positions(spark, sf_dir).select("updated_at", "event_id", "book_id", "chapter_index", "char_offset"), "updated_at", reading.HISTORY_LIMIT)
    h = newest.withColumn("place", F.row_number().over(Window.orderBy(F.col("updated_at").desc(), F.col("event_id").desc())) - 1).select("place", "book_id", "chapter_index", "char_offset")
    cursors = h.select("book_id", (F.col("book_id").cast("int") % 20).alias("cursor")).distinct()
    return reading.history_back(h, cursors)


@query(f"""with {E.BOOKS_SQL}, {LATEST_SQL} select l.book_id, l.chapter_index, b.title, b.author from latest l left join books b on b.book_id = l.book_id""")
def progress_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.progress_export(_latest(spark, sf_dir), E.books(spark, sf_dir)).select("book_id", "chapter_index", "title", "author")


@query(f"with {E.BOOKS_SQL}, {LATEST_SQL} select book_id, chapter_index from latest where book_id in (select book_id from books)")
def progress_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.importable(_latest(spark, sf_dir), E.books(spark, sf_dir)).select("book_id", "chapter_index")


# Merging: the library has the rows of ids not divisible by 3, the backup those not divisible by 5 -----------------------------------------


def _sides(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    k = F.col(key).cast("long")
    return df.filter(k % 3 != 0), df.filter(k % 5 != 0)


def _merged_books(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local, remote = _sides(E.books(spark, sf_dir).select("book_id", "title", "total_chapters"), "book_id")
        remote = remote.withColumn("total_chapters", F.col("total_chapters") + 100)
        return merge.merge_books(local, remote, mode)[0]

    clash = {
        "skip": "select book_id, title, total_chapters, case when book_id in (select book_id from r) then 'skipped' else 'kept' end as outcome from l union all select book_id, title, total_chapters, 'added' from r where book_id not in (select book_id from l)",
        "overwrite": "select book_id, title, total_chapters, 'kept' as outcome from l where book_id not in (select book_id from r) union all select book_id, title, total_chapters, case when book_id in (select book_id from l) then 'overwritten' else 'added' end from r",
        "coexist": f"select book_id, title, total_chapters, 'kept' as outcome from l union all select case when c then substr(sha1('import::' || book_id), 1, 12) else book_id end, case when c then title || '{merge.COPY_SUFFIX}' else title end, total_chapters, case when c then 'coexisted' else 'added' end from (select *, book_id in (select book_id from l) as c from r)",
    }[mode]
    sql = f"with {E.BOOKS_SQL}, l as (select book_id, title, total_chapters from books where cast(book_id as bigint) % 3 <> 0), r as (select book_id, title, total_chapters + 100 as total_chapters from books where cast(book_id as bigint) % 5 <> 0) {clash}"
    return run, sql


def _merged_progress(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local, remote = _sides(_latest(spark, sf_dir).select("book_id", "chapter_index", "updated_at"), "book_id")
        remote = remote.withColumn("updated_at", F.col("updated_at") + F.make_dt_interval((F.col("chapter_index") % 3 - 1))).withColumn("chapter_index", F.col("chapter_index") + 1000)
        return merge.merge_progress(local, remote, mode)

    wins = {"skip": "false", "overwrite": "true", "coexist": "r.updated_at > l.updated_at"}[mode]
    sql = f"""with {LATEST_SQL}, l as (select book_id, chapter_index, updated_at from latest where cast(book_id as bigint) % 3 <> 0),
      r as (select book_id, chapter_index + 1000 as chapter_index, updated_at + to_days(chapter_index % 3 - 1) as updated_at from latest where cast(book_id as bigint) % 5 <> 0)
      select coalesce(l.book_id, r.book_id) as book_id, case when l.book_id is null or (r.book_id is not null and {wins}) then r.chapter_index else l.chapter_index end as chapter_index,
        case when l.book_id is null or (r.book_id is not null and {wins}) then r.updated_at else l.updated_at end as updated_at from l full join r on l.book_id = r.book_id"""
    return run, sql


def _merged_marks(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        marks = _marks(spark, sf_dir).withColumn("n", F.substring("id", 2, 20).cast("long"))
        local, remote = (m.drop("n") for m in _sides(marks, "n"))
        return merge.merge_marks(local, remote.withColumn("selected_text", F.concat("selected_text", F.lit("!"))), mode)

    base = f"with {MARKS_SQL}, l as (select * from marks where cast(substr(id, 2) as bigint) % 3 <> 0), r as (select * replace (selected_text || '!' as selected_text) from marks where cast(substr(id, 2) as bigint) % 5 <> 0)"
    sql = {
        "skip": f"{base} select * from l union all select * from (select * from r where id not in (select id from l) and not exists (select 1 from l where l.book_id = r.book_id and l.chapter_index = r.chapter_index and l.char_offset = r.char_offset) qualify row_number() over (partition by book_id, chapter_index, char_offset order by created_at, id) = 1)",
        "overwrite": f"{base} select * from l where id not in (select id from r) union all select * from r",
        "coexist": f"{base} select * from l union all select * from r where id not in (select id from l)",
    }[mode]
    return run, sql


for _mode in merge.MODES:
    for _name, _make in (("merge_books", _merged_books), ("merge_progress", _merged_progress), ("merge_bookmarks", _merged_marks)):
        QUERIES[f"{_name}_{_mode}"], ORACLES[f"{_name}_{_mode}"] = _make(_mode)


@query(f"""with {E.SESSIONS_SQL}, s as (select book_id, started_at, duration_ms, event_id from sessions), l as (select * from s where event_id % 3 <> 0), r as (select * from s where event_id % 5 <> 0)
  select book_id, started_at, duration_ms from (select * from l union all select * from r where (book_id, started_at, duration_ms) not in (select (book_id, started_at, duration_ms) from l)) order by started_at desc, book_id, duration_ms, event_id limit 5000""")
def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    local, remote = _sides(E.sessions(spark, sf_dir).select("book_id", "started_at", "duration_ms", "event_id"), "event_id")
    return merge.merge_sessions(local, remote).select("book_id", "started_at", "duration_ms")


@query(f"""with {E.POSITIONS_SQL}, p as (select book_id, chapter_index, char_offset, updated_at as "at", event_id from positions)
  select * exclude (event_id) from (select * from p where event_id % 3 <> 0 union all select * from p where event_id % 5 <> 0 order by "at" desc, book_id, chapter_index, char_offset, event_id limit 500)""")
def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.positions(spark, sf_dir).select("book_id", "chapter_index", "char_offset", F.col("updated_at").alias("at"), "event_id")
    local, remote = _sides(p, "event_id")
    return merge.merge_history(local, remote).drop("event_id")


@query(f"with {E.BOOKS_SQL} select book_id, case when cast(book_id as bigint) % 4 = 0 then title || '*' else title end as title, cast(case when cast(book_id as bigint) % 4 = 0 then 7 else total_chapters end as integer) as total_chapters, author from books")
def patch_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.books(spark, sf_dir).select("book_id", "title", "total_chapters", "author")
    changes = b.filter(F.col("book_id").cast("long") % 4 == 0).select("book_id", F.concat("title", F.lit("*")).alias("title"), F.lit(7).alias("total_chapters"), F.lit(None).cast("string").alias("author"))
    return merge.patch(b, changes)


@query(f"with {E.BOOKS_SQL} select book_id, title from books where status <> '{FINISHED}'")
def remove_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.books(spark, sf_dir)
    return merge.remove(b, b.filter(F.col("status") == FINISHED).select("book_id"))[0].select("book_id", "title")


TITLES_SQL = "titles as (select cast(p_partkey as varchar) as book_id, p_name as title, p_brand as author, p_size as total_chapters, p_partkey as position, lower(replace(p_name, ' ', '')) as s from part)"
GRAMS_SQL = "grams as (select s, list_distinct(list_transform(generate_series(1, greatest(length(s) - 1, 1)), lambda i: substr(s, cast(i as integer), 2))) as g from (select distinct s from titles))"


@query(f"with {TITLES_SQL} select book_id, s as skeleton, substr(sha1('local::' || title), 1, 12) as own_id from titles")
def title_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillflow.functions.text import book_id
    from quillflow.functions.titles import skeleton

    return E.titles(spark, sf_dir).select("book_id", skeleton(F.col("title")).alias("skeleton"), book_id(F.lit("local"), F.col("title")).alias("own_id"))


@query(f"""with {TITLES_SQL}, {GRAMS_SQL} select a.s as skeleton_a, b.s as skeleton_b, len(list_intersect(a.g, b.g)) / cast(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) as double) as similarity from grams a join grams b on a.s < b.s
  where len(list_intersect(a.g, b.g)) / cast(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) as double) >= 0.5""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.title_pairs(E.titles(spark, sf_dir), 0.5)


#: Each title, in order of position, takes what is like it and not yet taken: one step a title, with a list of who took whom.
GROUPS_SQL = f"""{TITLES_SQL}, {GRAMS_SQL}, placed as (select *, row_number() over (order by position) as k from titles),
  alike as (select a.s as s, b.s as t from grams a join grams b on a.s = b.s or len(list_intersect(a.g, b.g)) / cast(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) as double) >= 0.75),
  rivals as (select a.k as n, list(b.k) as later from placed a join alike on alike.s = a.s join placed b on b.s = alike.t and b.k > a.k and a.author = b.author group by a.k),
  walk as (select cast(0 as bigint) as n, list_transform(generate_series(1, (select count(*) from titles)), lambda x: cast(0 as bigint)) as owner union all
    select w.n + 1, case when w.owner[w.n + 1] <> 0 then w.owner else list_transform(w.owner, lambda x, i: case when i = w.n + 1 or x = 0 and list_contains(coalesce(r.later, []), i) then w.n + 1 else x end) end
    from walk w left join rivals r on r.n = w.n + 1 where w.n < len(w.owner)),
  owned as (select t.*, owner[t.k] as seed from placed t cross join (select owner from walk where n = len(owner)) x),
  best as (select seed, first(book_id order by total_chapters desc, position) as keep, first(book_id order by k) as group_id, count(distinct s) as n_titles from owned group by seed having count(*) > 1),
  grouped as (select o.book_id, group_id, keep, case when n_titles = 1 then '{dedupe.NEARLY}' else '{dedupe.HIGHLY}' end as reason from owned o join best b on o.seed = b.seed)"""


@query(f"with recursive {GROUPS_SQL} select * from grouped")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_groups(E.titles(spark, sf_dir))


@query(f"with recursive {GROUPS_SQL} select book_id, total_chapters from titles where book_id not in (select book_id from grouped where book_id <> keep)")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles without those that the groups of duplicates do not keep."""
    t = E.titles(spark, sf_dir)
    pairs = dedupe.duplicate_groups(t).select(F.col("keep").alias("keep_id"), F.col("book_id").alias("drop_id"))
    return dedupe.merge_duplicates(t, pairs)[0].select("book_id", "total_chapters")
