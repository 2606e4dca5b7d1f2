"""Queries of chapters, search, import, pages and storage over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.functions import encoding
from quillflow.functions.html import parsed
from quillflow.functions.text import char_count, content_hash, segments
from quillflow.functions.titles import chapter_number
from quillflow.operators import chapters as ch
from quillflow.operators import cleaning, dedupe, fetching, importing, pages, schedule, search, storage
from quillflow.plans import entities as E
from quillflow.plans.shelf_queries import NOW, TITLES_SQL
from quillflow.schemas import CHAPTER_FAILED, CHAPTER_MISSING, CHAPTER_OK, FETCH_DONE, FETCH_NONE, FETCH_PARTIAL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WS = E.RE2_WS
ISSUES_SQL = f"""{E.LINES_SQL}, marked as (select *, lag(num) over w as before, min(pos) over (partition by book_id, title) as first_pos from lines window w as (partition by book_id order by pos)),
  issues as (select book_id, cast(pos as integer) as chapter_index, 'empty' as type from marked where char_count = 0
    union all select book_id, pos, case when fetched_at is not null then 'failed' else 'missing' end from marked where char_count <> 0 and not is_ok
    union all select book_id, pos, 'duplicate' from marked where pos > first_pos union all select book_id, pos, 'jump' from marked where before is not null and num <> before + 1)"""


@query(f"with {ISSUES_SQL} select * from issues")
def diagnose_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.diagnose(E.line_chapters(spark, sf_dir)).select("book_id", "chapter_index", "type")


@query(f"""with {ISSUES_SQL} select l.book_id, count(*) as total, {', '.join(f"coalesce(max({t}), 0) as {t}" for t in ch.ISSUES)} from lines l left join (
  select book_id, {', '.join(f"count_if(type = '{t}') as {t}" for t in ch.ISSUES)} from issues group by book_id) i on l.book_id = i.book_id group by l.book_id""")
def diagnose_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.diagnosis(E.line_chapters(spark, sf_dir))


@query(f"""with {E.CHAPTERS_SQL}, b as (select * from chapters where idx % 4 <> 0), a as (select book_id, idx, title, case when idx % 3 = 0 then content_hash || 'x' else content_hash end as content_hash, char_count from chapters where idx % 6 <> 0)
  select coalesce(a.book_id, b.book_id) as book_id, coalesce(a.idx, b.idx) as "index", case when b.idx is null then 'added' when a.idx is null then 'removed' when a.content_hash <> b.content_hash and a.content_hash <> '' and b.content_hash <> '' then 'revised' else 'unchanged' end as change
  from (select * from a where book_id in (select book_id from b)) a full join b on a.book_id = b.book_id and a.idx = b.idx""")
def chapter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    before = ch.snapshot(c.filter("index % 4 <> 0"), F.lit(NOW))
    now = c.filter("index % 6 <> 0").withColumn("content_hash", F.when(F.col("index") % 3 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return ch.diff(now, before).select("book_id", "index", "change")


@query(f"""with {E.CHAPTERS_SQL} select book_id, idx as "index", case when is_ok then '{CHAPTER_OK}' when fetched_at is not null then '{CHAPTER_FAILED}' else '{CHAPTER_MISSING}' end as state, char_count from chapters""")
def chapter_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.states(E.chapters(spark, sf_dir)).select("book_id", "index", "state", "char_count")


@query(f"""with {E.CHAPTERS_SQL} select book_id, count_if(not is_ok) as n_failed, case when count_if(not is_ok) = 0 then '{FETCH_DONE}' when count_if(not is_ok) = count(*) then '{FETCH_NONE}' else '{FETCH_PARTIAL}' end as fetch_status from chapters group by book_id""")
def fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.fetch_status(E.chapters(spark, sf_dir))


@query(f"""with {E.CHAPTERS_SQL} select book_id, idx as "index", title, char_count, lag(idx) over w as prev_index, lead(idx) over w as next_index from chapters window w as (partition by book_id order by idx)""")
def reader_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.neighbours(E.chapters(spark, sf_dir)).select("book_id", "index", "title", "char_count", "prev_index", "next_index")


@query(f"""with {E.CHAPTERS_SQL} select book_id, cast(row_number() over (partition by book_id order by idx) as integer) as "index", title from chapters where idx <> 2""")
def delete_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    return ch.delete(c, c.select("book_id").distinct().withColumn("at_index", F.lit(2))).select("book_id", "index", "title")


@query(f"""with {E.CHAPTERS_SQL} select book_id, idx as "index", case when idx = 1 then 'New ' || book_id else title end as title from chapters""")
def rename_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    names = c.select("book_id").distinct().select("book_id", F.lit(1).alias("at_index"), F.concat(F.lit(" New "), "book_id", F.lit(" ")).alias("new_title"))
    return ch.rename(c, names).select("book_id", "index", "title")


@query(f"""with {E.CHAPTERS_SQL}, o as (select *, case when idx = 1 then case when strpos(substr(content, length(content) // 2 + 1), chr(10)) > 0 then length(content) // 2 + strpos(substr(content, length(content) // 2 + 1), chr(10)) else length(content) // 2 end end as cut from chapters),
  p as (select book_id, idx, 0 as part, title, case when cut > 0 and cut < length(content) then regexp_replace(substr(content, 1, cut), '\n+$', '') else content end as content from o
    union all select book_id, idx, 1, title || '（下）', regexp_replace(substr(content, cut + 1), '^\n+', '') from o where cut > 0 and cut < length(content))
  select book_id, cast(row_number() over (partition by book_id order by idx, part) as integer) as "index", title, sha1(content) as content_sha from p""")
def split_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    cuts = c.select("book_id").distinct().select("book_id", F.lit(1).alias("at_index"), F.lit(None).cast("int").alias("at_offset"), F.lit(None).cast("string").alias("new_title"))
    return ch.split(c, cuts).select("book_id", "index", "title", F.sha1("content").alias("content_sha"))


@query(f"""with {E.CHAPTERS_SQL}, n as (select book_id, max(idx) as last from chapters group by book_id), c as (select c.*, n.last >= 3 and idx in (2, 3) as inside from chapters c join n on c.book_id = n.book_id),
  m as (select book_id, 2 as idx, min(case when idx = 2 then title end) || ' ～ ' || min(case when idx = 3 then title end) as title, string_agg('【' || title || '】' || case when content <> '' then chr(10) || chr(10) || content else '' end, chr(10) || chr(10) order by idx) as content from c where inside group by book_id)
  select book_id, cast(row_number() over (partition by book_id order by idx) as integer) as "index", title, sha1(content) as content_sha from (select book_id, idx, title, content from c where not inside union all select * from m)""")
def merge_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    ranges = c.select("book_id").distinct().select("book_id", F.lit(2).alias("at_index"), F.lit(2).alias("n"), F.lit("").alias("new_title"))
    return ch.merge(c, ranges).select("book_id", "index", "title", F.sha1("content").alias("content_sha"))


@query(f"""with {E.CHAPTERS_SQL} select book_id, sha1(string_agg(title || case when content <> '' then chr(10) || chr(10) || content else '' end, chr(10) || chr(10) order by idx)) as text_sha from chapters group by book_id""")
def rebuild_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.source_text(E.chapters(spark, sf_dir)).select("book_id", F.sha1("text").alias("text_sha"))


@query(f"""with {E.CHAPTERS_SQL}, {E.BOOKS_SQL}, t as (select book_id, string_agg(title || case when content <> '' then chr(10) || chr(10) || content else '' end, chr(10) || chr(10) order by idx) as body from chapters group by book_id)
  select b.book_id, sha1(regexp_replace(b.title || chr(10) || '作者：' || author || chr(10) || '来源：' || source_site || coalesce(chr(10) || chr(10) || body, ''), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) as text_sha
  from books b left join t on b.book_id = t.book_id""")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.export_text(E.books(spark, sf_dir), E.chapters(spark, sf_dir)).select("book_id", F.sha1("text").alias("text_sha"))


#: Fields in this order, none of them null, without white space; control characters and quotes escaped as both engines do.
@query(f"""with {E.CHAPTERS_SQL}, j as (select book_id, to_json({{'format': 'book-export', 'version': 1, 'book': {{'book_id': book_id, 'chapters': list({{'index': idx, 'title': title, 'char_count': char_count, 'content_hash': content_hash, 'content': content}} order by idx)}}}}) as j from chapters group by book_id)
  select book_id, cast(length(cast(j as varchar)) as integer) as n_chars, sha1(cast(j as varchar)) as json_sha from j""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    return ch.export_json(c.select("book_id").distinct(), c).select("book_id", F.length("json").alias("n_chars"), F.sha1("json").alias("json_sha"))


@query(f"""with {E.LINES_SQL} select book_id, cast(pos as integer) as pos, title, num as number from lines""")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.line_chapters(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("position")))
    return rows.select("book_id", "pos", "title", chapter_number(F.col("title")).alias("number"))


@query(f"""with {E.CHAPTERS_SQL}, k as (select book_id, idx, title, lower(regexp_replace(regexp_replace(title, '{WS}+', '', 'g'), '[·・:：\\-_—.,，。！!？?、''"“”‘’《》<>]', '', 'g')) as key from chapters),
  have as (select * from k where idx <> 3), links as (select book_id, idx, title, key, 'http://x/' || book_id || '/' || cast(idx as varchar) as url from k)
  select l.book_id, l.idx as "index", l.title, l.url from links l where l.key <> '' and not exists (select 1 from have h where h.book_id = l.book_id and h.key = l.key)
    and not exists (select 1 from have h where h.book_id = l.book_id and h.idx = l.idx and h.key <> '')""")
def update_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    links = c.select("book_id", "index", "title", F.concat(F.lit("http://x/"), "book_id", F.lit("/"), F.col("index").cast("string")).alias("url"))
    return schedule.new_links(links, c.filter("index <> 3").select("book_id", "index", "title"))


# Search ------------------------------------------------------------------------------------------------------------------------------------

COLLAPSED = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
Q = "The the"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = E.table(spark, sf_dir, "documents")
    return search.index(docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("index"), F.lit("").alias("title"), F.lit("").alias("content_hash"), F.col("text").alias("content")))


@query(f"""with t as (select source, lower({COLLAPSED}) as x from documents), h as (select source as book_id, (length(x) - length(replace(x, '{Q.lower()}', ''))) // {len(Q)} as n from t where contains(x, '{Q.lower()}'))
  select book_id, book_id as title, '' as author, cast(sum(least(n, 200)) as bigint) as n_hits, count(*) as n_chapters from h group by book_id order by book_id limit 10""")
def search_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = E.table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct().select("book_id", F.col("book_id").alias("title"), F.lit("").alias("author"), F.col("book_id").alias("position"))
    return search.search(_indexed(spark, sf_dir), library, Q, 10).select("book_id", "title", "author", "n_hits", "n_chapters")


@query(f"""with t as (select source as book_id, doc_id as chapter_index, {COLLAPSED} as x from documents), h as (select *, strpos(lower(x), '{Q.lower()}') - 1 as p from t where contains(lower(x), '{Q.lower()}'))
  select book_id, chapter_index, p as position, least(200, (length(x) - length(replace(lower(x), '{Q.lower()}', ''))) // {len(Q)}) as n_hits, substr(x, greatest(0, p - 34) + 1, least(length(x), p + {len(Q)} + 34) - greatest(0, p - 34)) as text,
    p - greatest(0, p - 34) as offset_in_snippet, p > 34 as prefix_trimmed, p + {len(Q)} + 34 < length(x) as suffix_trimmed from h""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first snippet of each text that has any."""
    found = search.matches(_indexed(spark, sf_dir), Q)
    first = Window.partitionBy("book_id", "chapter_index").orderBy("position")
    return search.snippets(found, Q).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "chapter_title")


SHORT_QUERIES = [(-1, "DE"), (-2, "of  the"), (-3, "e"), (-4, " "), (-5, "a th"), (-6, None)]


@query(f"""with d as (select doc_id, lower({COLLAPSED}) as x from documents), q as (select item_id, lower({COLLAPSED}) as k from (select item_id, text from benchmark union all values (-1, 'DE'), (-2, 'of  the'), (-3, 'e'), (-4, ' '), (-5, 'a th'), (-6, null)))
  select doc_id as text_id, item_id as query_id, cast((length(x) - length(replace(x, k, ''))) // length(k) as integer) as n_hits from d join q on contains(x, k) where k <> ''""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items and some short queries, looked for in all documents."""
    texts, queries = E.table(spark, sf_dir, "documents"), E.table(spark, sf_dir, "benchmark")
    asked = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")).unionByName(spark.createDataFrame(SHORT_QUERIES, "query_id long, q string"))
    return search.search_many(texts.select(F.col("doc_id").alias("text_id"), "text"), asked)


@query(f"""with i as (select source as book_id, sum(length({COLLAPSED})) as n, count(*) as k from documents where source <> 'src3' group by source), b as (select distinct source as book_id from documents where source <> 'src5')
  select coalesce(i.book_id, b.book_id) as book_id, case when b.book_id is null then 'stale' when i.book_id is null then 'missing' else 'indexed' end as state, cast(coalesce(n, 0) as bigint) as n_chars, coalesce(k, 0) as n_chapters from i full join b on i.book_id = b.book_id""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = E.table(spark, sf_dir, "documents").select(F.col("source").alias("book_id")).distinct().filter("book_id <> 'src5'")
    return search.index_status(_indexed(spark, sf_dir).filter("book_id <> 'src3'"), shelf)


def trimmed(sql: str) -> str:
    return f"regexp_replace({sql}, '^{WS}+|{WS}+$', '', 'g')"


TWO, BRACKET, THREE = r"^(.+?)\s*[-_|]\s*(.+)$", r"^(.+?)\s*[（(]([^）)]+)[）)]", r"^(.+?)\s*[_\-|]\s*(.+?)\s*[_\-|]\s*(.+)$"
SKELETON_SQL = f"""lower(regexp_replace(regexp_replace(regexp_replace(title, '[（(\\[【][^）)\\]】]*[）)\\]】]', '', 'g'), '{WS}+', '', 'g'), '[·・:：\\-_—.,，。！!？?、''"“”‘’《》<>]', '', 'g'))"""


# Captures ----------------------------------------------------------------------------------------------------------------------------------


@query(f"""with {E.CHAPTERS_SQL}, base as (select * from chapters where idx <= 6), cap as (select row_number() over (order by cast(book_id as bigint), idx) as capture_id, book_id, title, content_hash, cast(regexp_extract(title, 'Chapter ([0-9]+)', 1) as bigint) as number from chapters),
  n as (select book_id, count(*) as total from base group by book_id),
  j as (select c.*, (select min(idx) from base b where b.book_id = c.book_id and b.content_hash = c.content_hash and coalesce(b.content_hash, '') <> '') as same_text, (select min(idx) from base b where b.book_id = c.book_id and b.title = c.title) as same_title,
    exists (select 1 from base b where b.book_id = c.book_id and b.idx = c.number and not b.is_ok) as open, coalesce(n.total, 0) as total from cap c left join n on n.book_id = c.book_id)
  select capture_id, book_id, case when same_text is not null then 'skip' when open then 'fill' when same_title is not null then 'replace' else 'append' end as action,
    cast(case when same_text is not null then same_text when open then number when same_title is not null then same_title else total + 1 end as integer) as chapter_index from j""")
def capture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    sizes = c.groupBy(F.col("book_id").alias("_b")).agg(F.count("*").alias("_k"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy(F.col("_b").cast("long")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("book_id").orderBy("index"))
    captures = c.join(before, F.col("book_id") == F.col("_b")).select((F.col("_before") + within).alias("capture_id"), "book_id", "title", "content_hash")
    return dedupe.plan_captures(captures, c.filter("index <= 6"))


#: A page's title and author by the marks between them, as its <title> has them.
META_SQL = f"""raw as (select page_id, {trimmed("replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\n\\t]+', ' ', 'g'), '&amp;', '&')")} as t, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as site from pages),
  named as (select page_id, site, case when regexp_matches(t, '{THREE}') then regexp_extract(t, '{THREE}', 1) when regexp_matches(t, '{BRACKET}') then regexp_extract(t, '{BRACKET}', 1) when regexp_matches(t, '{TWO}') then regexp_extract(t, '{TWO}', 1) else t end as name,
    case when regexp_matches(t, '{THREE}') then regexp_extract(t, '{THREE}', 2) when regexp_matches(t, '{BRACKET}') then regexp_extract(t, '{BRACKET}', 2) when regexp_matches(t, '{TWO}') then regexp_extract(t, '{TWO}', 2) else '' end as who from raw),
  meta as (select page_id, coalesce(nullif({trimmed('name')}, ''), nullif(site, ''), '未命名') as title, {trimmed('who')} as author, site from named)"""


@query(f"""with {META_SQL}, {TITLES_SQL}, p as (select page_id, site, {SKELETON_SQL} as s from meta),
  gram as (select s, list_distinct(list_transform(generate_series(1, greatest(length(s) - 1, 1)), lambda i: substr(s, cast(i as integer), 2))) as g from (select s from p union select s from titles) where s <> ''),
  alike as (select a.s as s, b.s as t from gram a join gram b on a.s = b.s or ((contains(a.s, b.s) or contains(b.s, a.s)) and least(length(a.s), length(b.s)) >= 2) or len(list_intersect(a.g, b.g)) / cast(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) as double) >= 0.6 where a.s in (select s from p) and b.s in (select s from titles)),
  c as (select p.page_id, t.book_id, t.total_chapters, case when site = 'example.com' and site <> '' then 0 else 1 end as rank from p join alike using (s) join titles t on t.s = alike.t qualify row_number() over (partition by page_id order by rank, position, book_id) = 1)
  select p.page_id, case rank when 0 then 'same-site' when 1 then 'same-title' else 'new' end as via, book_id, cast(coalesce(total_chapters, 0) + 1 as integer) as next_index from p left join c on p.page_id = c.page_id""")
def capture_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(E.table(spark, sf_dir, "pages"), "page_id", "url")
    meta = pages.book_meta(p).select("page_id", F.col("site").alias("host"), "title", F.lit(None).cast("string").alias("book_id"))
    books = E.titles(spark, sf_dir).select("book_id", "title", F.lit("example.com").alias("source_site"), "total_chapters", "position")
    return dedupe.resolve_pages(meta, books)


# Text --------------------------------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, length(regexp_replace(text, '{WS}+', '', 'g')) as char_count, sha1(regexp_replace(text, '{WS}+', '', 'g')) as content_hash from documents")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", char_count("text").alias("char_count"), content_hash("text").alias("content_hash"))


@query(f"select content_hash, count(*) as n, min(doc_id) as first_id from (select doc_id, sha1(regexp_replace(text, '{WS}+', '', 'g')) as content_hash from documents) group by content_hash having count(*) > 1")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"""select doc_id, cast(line_no as integer) as line_no from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as line_no from (select doc_id, string_split(text || case when doc_id % 5 = 0 then chr(10) || ' www.site' || doc_id || '.example/book' when doc_id % 5 = 1 then chr(10) || '记住本书' else '' end, chr(10)) as lines from documents))
  where line = '记住本书' or regexp_matches(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), '(?i)^(?:https?://|www\\.|[a-z0-9-]+\\.(?:com|net|cn|org|cc|info|xyz)(?:/|\\s|$))')""")
def ad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertising lines of documents, two in five of which have had one put behind them."""
    i = F.col("doc_id")
    ad = F.when(i % 5 == 0, F.concat(F.lit("\n www.site"), i.cast("string"), F.lit(".example/book"))).when(i % 5 == 1, "\n记住本书").otherwise("")
    lines = E.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", ad), "\n")).alias("line_no", "line"))
    return lines.filter(cleaning.ad_label(F.col("line")).isNotNull()).select("doc_id", "line_no")


@query(f"""with l as (select doc_id, list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: not regexp_matches(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g'), '(?i)^(?:https?://|www\\.|[a-z0-9-]+\\.(?:com|net|cn|org|cc|info|xyz)(?:/|\\s|$))')) as kept, text from documents),
  c as (select doc_id, regexp_replace(array_to_string(list_transform(kept, lambda x: regexp_replace(x, '^[ \\t\\x{{3000}}]+', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') as cleaned, text from l)
  select doc_id, sha1(cleaned) as cleaned_sha, abs(length(text) - length(cleaned)) as n_changed from c""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cleaning.clean(E.table(spark, sf_dir, "documents"), ad_lines=True, indent=True, blank_lines=True)
    return done.select("doc_id", F.sha1("cleaned").alias("cleaned_sha"), "n_changed")


@query(r"""with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\.{3,}', '……', 'g'), '。{2,}', '……', 'g'), '…{3,}', '……', 'g') as done,
  replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as was from documents)
  select doc_id, cast(done <> was as integer) as n_marks, sha1(done) as cleaned_sha from c""")
def punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cleaning.clean(E.table(spark, sf_dir, "documents"), punctuation=True)
    return done.select("doc_id", "n_marks", F.sha1("cleaned").alias("cleaned_sha"))


def _sections_sql(head: str) -> str:
    """Chapters of documents where `head` tells whether a trimmed line is a heading."""
    return f"""with l as (select doc_id, unnest(lines) as raw, generate_subscripts(lines, 1) as n from (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as lines from documents)),
  t as (select *, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') as line from l), h as (select *, {head} as head from t), s as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by n) as sec, max(case when head then 1 else 0 end) over (partition by doc_id) as any_head from h),
  c as (select doc_id, sec, max(any_head) as any_head, max(case when head then line end) as title, regexp_replace(string_agg(raw, chr(10) order by n), '^\n+|\n+$', '', 'g') as content, max(case when line <> '' then 1 else 0 end) as solid from s group by doc_id, sec),
  k as (select *, row_number() over (partition by doc_id order by sec) as i from c where sec > 0 or any_head = 0 or solid = 1)
  select doc_id, cast(i as integer) as "index", case when any_head = 0 then '全文' when sec = 0 then '卷首' else title end as title, sha1(content) as content_sha, length(regexp_replace(content, '{WS}+', '', 'g')) as char_count, any_head = 1 and sec = 0 as is_preface from k"""


@query(_sections_sql("regexp_matches(line, '^(The|La|Der|Que) ') and length(line) <= 60"))
def chapterize_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importing.chapterize(E.table(spark, sf_dir, "documents").select("doc_id", "text"), pattern="^(The|La|Der|Que) ")
    return rows.select("doc_id", "index", "title", F.sha1("content").alias("content_sha"), "char_count", "is_preface")


NUM_SQL = "[0-9０-９零〇一二三四五六七八九十百千万两]{1,12}"
DEFAULT_SQL = f"^{WS}*(?:#{{1,4}}{WS}*)?(第{WS}*{NUM_SQL}{WS}*[章回节卷篇集部]|Chapter{WS}*[0-9]{{1,5}}|(?:序章|序言|自序|楔子|引子|前言|后记|尾声|终章|大结局|外篇|番外(?:篇)?)){WS}*[：:、.．\\-—]?{WS}*(.*?){WS}*$"


@query(_sections_sql(f"line <> '' and length(line) <= 60 and regexp_matches(line, '{DEFAULT_SQL}') and length(regexp_extract(line, '{DEFAULT_SQL}', 2)) <= 45 and not regexp_matches(regexp_extract(line, '{DEFAULT_SQL}', 2), '[。！？；…]')"))
def chapterize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importing.chapterize(E.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "index", "title", F.sha1("content").alias("content_sha"), "char_count", "is_preface")


@query(f"""select doc_id, 'UTF-8' as encoding, case when text = '' then 0.0 else 0.98 end::double as confidence, text <> '' as confident, case when regexp_replace(text, '{WS}+', '', 'g') = '' then 'empty' when not contains(text, chr(65533)) then null::varchar end as rejected from documents""")
def import_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: detected, decoded and gated."""
    d = E.table(spark, sf_dir, "documents")
    up = d.select("doc_id", F.lit(None).cast("string").alias("text"), F.encode("text", "UTF-8").alias("upload"), F.lit(None).cast("string").alias("data_base64"), F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("encoding"))
    # what was found is kept beside the gate: bytes are detected once, and no join takes repeated ids for each other or leaves out null ones
    gated = importing.gates(importing.resolve_source(up, "found"))
    return gated.select("doc_id", "found.encoding", "found.confidence", "found.confident", "rejected")


@query()
def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as UTF-16LE without a mark, detected."""
    d = E.table(spark, sf_dir, "documents")
    return d.select("doc_id", encoding.detect(F.encode("text", "UTF-16LE")).alias("d"), encoding.zero_parity(F.encode("text", "UTF-16LE")).alias("parity")).select("doc_id", "d.encoding", "d.confidence", "parity")


@query("""select doc_id, length(text) - length(replace(text, chr(65533), '')) as n_lost, regexp_matches(text, '[\\x{A1}-\\x{FF}]{4,}') or regexp_matches(text, '(?:[\\x{C0}-\\x{FF}][\\x{80}-\\x{BF}]){2,}') or contains(text, chr(65533)) or regexp_matches(text, '[\\x{E000}-\\x{F8FF}]{2,}') or contains(text, '锟斤拷') as mojibake from documents""")
def mojibake_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", encoding.inspect(F.col("text")).alias("s")).select("doc_id", "s.n_lost", "s.mojibake")


@query()
def recover_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", encoding.recover(F.col("text")).alias("r")).select("doc_id", "r.applied", "r.chain", "r.unrecoverable", "r.partial")


_COUNT = lambda chars: f"len(regexp_extract_all(text, '[{chars}]'))"
_BAD, _CJK, _OFTEN = _COUNT(r"\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x{e000}-\x{f8ff}"), _COUNT(r"\x{4e00}-\x{9fff}\x{3000}-\x{303f}"), _COUNT("".join(dict.fromkeys(encoding.FREQUENT)))


@query(f"""with c as (select doc_id, greatest(length(text), 1)::double as n, length(text) as size, {_BAD} as bad, {_CJK} as cjk, {_OFTEN} as often from documents)
  select doc_id, round(case when size > 0 then (n - bad) / n * 40 + cjk / n * 25 + case when cjk / n > 0.02 then often / cjk::double * 35 else 0 end - bad / n * 120 else -50 end, 6) as score, round(bad / n, 6) as bad_ratio, round(cjk / n, 6) as cjk_ratio from c""")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.table(spark, sf_dir, "documents").select("doc_id", encoding.text_scores(F.col("text")).alias("s"))
    return s.select("doc_id", F.round("s.score", 6).alias("score"), F.round("s.bad_ratio", 6).alias("bad_ratio"), F.round("s.cjk_ratio", 6).alias("cjk_ratio"))


@query("""select doc_id, '开头' as label, substr(text, 1, 300) as text from documents union all select doc_id, '中间', substr(text, length(text) // 2 + 1, 300) from documents where length(text) > 1200
  union all select doc_id, '结尾', substr(text, greatest(length(text) - 299, 1)) from documents where length(text) > 900""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", F.explode(segments(F.col("text"))).alias("s")).select("doc_id", "s.label", "s.text")


# Pages -------------------------------------------------------------------------------------------------------------------------------------


@query("""select page_id, n, title, href from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as title, cast(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 as integer) as n from pages)
  where href <> '' and title <> '' qualify row_number() over (partition by page_id, href order by n) = 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_links(parsed(E.table(spark, sf_dir, "pages"), "page_id", "url")).select("page_id", "n", "title", "href")


@query("""with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) as hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) as titles from pages),
  s as (select page_id, d.depth, len(hrefs) as n_links, -1.2 * len(hrefs) + 0.5 * least(len(list_distinct(hrefs)), 6) + 2 * case when list_avg(list_transform(titles, lambda t: length(t))) between 2 and 26 then 1.0 else 0.3 end + 0.3 * d.depth as score
    from l cross join (values (3), (4)) d(depth) where len(hrefs) >= 3) select page_id, cast(depth as integer) as depth, cast(n_links as integer) as n_links, round(score, 6)::double as score from s""")
def toc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of three links or more with its score, also those too low for a table of contents."""
    return pages.toc_candidates(parsed(E.table(spark, sf_dir, "pages"), "page_id"), least=-1e9).select("page_id", "depth", "n_links", "score")


@query()
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.content_candidates(parsed(E.table(spark, sf_dir, "pages"), "page_id")).select("page_id", "place", "selector", "n_chars", "score")


@query(f"with {META_SQL} select * from meta")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.book_meta(parsed(E.table(spark, sf_dir, "pages"), "page_id", "url"))


@query()
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(parsed(E.table(spark, sf_dir, "pages"), "page_id")).select("page_id", "title", "char_count", "n_removed", F.sha1("content").alias("content_sha"))


@query("""select page_id, regexp_matches(html, '登录|(?i)<input[^>]+type=["'']?password') as login, regexp_matches(html, '(?i)VIP\\s*(章节|会员|专享|阅读)|付费|(购买|订阅)(本章|全书|本书|后阅读)|试读') as paywall from pages""")
def wall_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.walls(E.table(spark, sf_dir, "pages")).select("page_id", (F.size("login") > 0).alias("login"), (F.size("paywall") > 0).alias("paywall"))


@query("""with u as (select page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) as h, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as p from pages)
  select page_id, case when ends_with(h, 'example.org') and starts_with(p, '/en/') then 'robots' when page_id % 11 = 0 then 'network' when page_id % 7 = 0 then 'http_error' end as reason from u""")
def inspect_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.table(spark, sf_dir, "pages").withColumn("status", F.when(F.col("page_id") % 11 == 0, F.lit(None).cast("int")).when(F.col("page_id") % 7 == 0, 404).otherwise(200))
    origin = F.concat(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))), F.lit("://"), pages.host(F.col("url")))
    rules = p.select(origin.alias("origin")).distinct().filter("origin like '%example.org'").select("origin", F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /en/\n").alias("robots"))
    return pages.inspect(p, rules)


# Tasks and storage -------------------------------------------------------------------------------------------------------------------------


@query("""with r as (select 'h' || (user_id % 5) as host, epoch_us(ts) // 100000 as at_ms, event_id as request_id from events), k as (select *, row_number() over w as k from r window w as (partition by host order by at_ms, request_id)),
  s as (select *, k * 3000 + max(at_ms - k * 3000) over (partition by host order by at_ms, request_id) as start_ms from k) select host, request_id, start_ms, start_ms - at_ms as wait_ms from s""")
def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events")
    r = e.select(F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100).cast("long").alias("at_ms"), F.col("event_id").alias("request_id"))
    return fetching.paced(r).select("host", "request_id", "start_ms", "wait_ms")


@query("""select reason, count(*) as n, coalesce(case reason when 'ROBOTS_DISALLOWED' then 'robots.txt 禁止' when 'EMPTY_CONTENT' then '抓到的内容是空的' end, '抓取失败') as label
  from (select case event_id % 3 when 0 then 'ROBOTS_DISALLOWED' when 1 then 'EMPTY_CONTENT' else 'OTHER' end as reason from events where event_type = 'error') group by reason""")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events").filter("event_type = 'error'")
    reason = F.when(F.col("event_id") % 3 == 0, "ROBOTS_DISALLOWED").when(F.col("event_id") % 3 == 1, "EMPTY_CONTENT").otherwise("OTHER")
    return fetching.failure_histogram(e.select(reason.alias("reason")))


@query("""with t as (select user_id as task_id, count(*) as total, count_if(event_type = 'error') as failed, count_if(event_type = 'view') as done, min(epoch_us(ts) // 1000) as started_ms from events group by user_id)
  select task_id, total, 1706659200000 - started_ms as elapsed_ms, case when done + failed > 0 and done + failed < total then cast(floor((1706659200000 - started_ms) / cast(done + failed as double) * (total - (done + failed)) + 0.5) as bigint) end as eta_ms from t""")
def task_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events")
    t = e.groupBy(F.col("user_id").alias("task_id")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "view").alias("done"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("started_ms"))
    return fetching.timing(t.withColumn("finished_ms", F.lit(None).cast("long")), F.lit(1706659200000)).select("task_id", "total", "elapsed_ms", F.col("eta_ms").cast("long").alias("eta_ms"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.table(spark, sf_dir, "documents")
    top = F.element_at(F.array(F.lit("books/"), F.lit("index/"), F.lit(".trash/"), F.lit("reading/"), F.lit(".staging/")), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.concat(top, "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 3, ".bak").otherwise(".txt")).alias("path"), F.octet_length("text").alias("bytes"))


FILES_SQL = "files as (select case doc_id % 5 when 0 then 'books/' when 1 then 'index/' when 2 then '.trash/' when 3 then 'reading/' else '.staging/' end || source || '/' || doc_id || case when doc_id % 10 = 3 then '.bak' else '.txt' end as path, strlen(text) as bytes from documents)"


@query(f"""with {FILES_SQL}, r as (select split_part(path, '/', 1) as section, case when path like 'books/%' then split_part(path, '/', 2) end as owner, bytes from files)
  select section, owner, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from r where owner is not null group by section, owner union all select section, null, count(*), cast(sum(bytes) as bigint) from r group by section union all select null, null, count(*), cast(sum(bytes) as bigint) from r""")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.usage(_files(spark, sf_dir)).select("section", "owner", "n_files", "bytes")


@query(f"with {FILES_SQL}, b as (select split_part(path, '/', 2) as book_id, sum(bytes) as bytes, count(*) as n from files group by 1) select book_id, cast(bytes as bigint) as bytes, cast(row_number() over (order by bytes desc, book_id) as integer) as by_bytes, cast(row_number() over (order by n desc, book_id) as integer) as by_chapters from b")
def storage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books' places by size and by number of chapters. There are as many rows as sources, which one task numbers."""
    b = _files(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("book_id")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("total_chapters")).withColumn("title", F.col("book_id"))
    place = lambda by, name: storage.listed(b, by).withColumn("_n", F.monotonically_increasing_id()).select("book_id", F.row_number().over(Window.orderBy("_n")).alias(name))
    return b.select("book_id", "bytes").join(place("bytes", "by_bytes"), "book_id").join(place("chapters", "by_chapters"), "book_id")


@query(f"with {FILES_SQL} select 'library-backup' as format, 1 as version, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from files where not (path like '.trash/%' or path like '.staging/%' or path like 'index/%' or path like '%.bak')")
def backup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.backup_manifest(_files(spark, sf_dir))


@query(f"with {FILES_SQL} select case when path like '.trash/%' then 'trash' when path like '.staging/%' then 'staging' else 'rebuild-index' end as target, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from files where path like '.trash/%' or path like '.staging/%' or path like 'index/%' group by 1")
def cleanup_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.cleanup(_files(spark, sf_dir), ["trash", "staging", "rebuild-index"])


@query("""select 'e' || event_id || '.json' as file, case when event_id % 4 <> 0 then 'ok' when event_id % 8 = 0 then 'recovered' else 'corrupt' end as status from events""")
def json_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = E.table(spark, sf_dir, "events"), F.col("event_id")
    name = F.concat(F.lit("e"), i.cast("string"), F.lit(".json"))
    main = e.select(name.alias("path"), F.when(i % 4 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("text"))
    spare = e.filter(i % 8 == 0).select(F.concat(name, F.lit(".bak")).alias("path"), F.col("props").alias("text"))
    return storage.json_health(main.unionByName(spare))


@query("select event_id, ts from events where epoch(timestamp '2024-01-17 12:00:00') - epoch(date_trunc('second', ts)) > 7200")
def staging_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.expired(E.table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit(NOW).cast("timestamp_ntz"))


@query(f"""with {E.CHAPTERS_SQL} select book_id, idx as "index", 'books/' || book_id || '/chapters/' || case when idx < 10000 then lpad(cast(idx as varchar), 4, '0') else cast(idx as varchar) end || '.txt' as path, regexp_replace(title, '[\\\\/:*?"<>|]', '_', 'g') || '.txt' as file, length(content) as n_chars from chapters""")
def export_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.export_chapters(E.chapters(spark, sf_dir)).select("book_id", "index", "path", "file", F.length("text").alias("n_chars"))


@query(f"""with {E.CHAPTERS_SQL} select book_id, timestamp '{NOW}' as taken_at, idx as "index", title, content_hash, char_count from chapters""")
def toc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.snapshot(E.chapters(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query(f"with {ISSUES_SQL} select book_id, chapter_index, string_agg(type, ',' order by type) as types from issues group by book_id, chapter_index")
def issues_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.with_issues(E.line_chapters(spark, sf_dir)).select("book_id", "chapter_index", F.array_join("types", ",").alias("types"))


@query(f"""with {E.CHAPTERS_SQL}, marked as (select book_id, idx, title, content, regexp_matches({trimmed('title')}, '^Chapter [0-9]+ (user|assistant)$') as head, sum(case when regexp_matches({trimmed('title')}, '^Chapter [0-9]+ (user|assistant)$') then 1 else 0 end) over (partition by book_id order by idx) as part from chapters),
  parts as (select book_id, part, first(title order by idx) as title, string_agg(title || content, '' order by idx) as body, bool_or(head) as headed from marked group by book_id, part)
  select book_id, cast(row_number() over (partition by book_id order by part) as integer) as "index", case when headed then {trimmed('title')} when count(*) over (partition by book_id) = 1 then '全文' else '卷首' end as title, cast(length(regexp_replace(body, '{WS}+', '', 'g')) as integer) as char_count from parts""")
def rechapterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importing.rechapterize(E.chapters(spark, sf_dir), pattern="^Chapter [0-9]+ (user|assistant)$").select("book_id", "index", "title", "char_count")


@query(f"""with {E.CHAPTERS_SQL}, w as (select book_id, idx, title from chapters where idx <> 4), g as (select book_id, idx, case when idx = 2 then title || '!' else title end as title from chapters)
  select coalesce(w.book_id, g.book_id) as book_id, count(w.title) as n_expected, count(g.title) as n_found, min(case when w.title is distinct from g.title then coalesce(w.idx, g.idx) end) as first_difference,
    count(w.title) = count(g.title) and min(case when w.title is distinct from g.title then coalesce(w.idx, g.idx) end) is null as ok from w full join g on w.book_id = g.book_id and w.idx = g.idx group by 1""")
def verify_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    found = c.withColumn("title", F.when(F.col("index") == 2, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return ch.verify(found, c.filter("index <> 4"))


@query(f"""with {E.CHAPTERS_SQL}, l as (select book_id as task_id, idx, case when is_ok and fetched_at is not null then 'skipped' when is_ok then 'ok' when fetched_at is not null then 'failed' end as outcome from chapters)
  select task_id, count(*) as total, count_if(outcome = 'failed') as failed, count_if(outcome = 'skipped') as skipped, count(*) - count_if(outcome = 'failed') - count_if(outcome = 'skipped') as success from l group by task_id""")
def fetch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir).withColumnRenamed("book_id", "task_id")
    outcome = F.when(F.col("is_ok") & F.col("fetched_at").isNotNull(), "skipped").when(F.col("is_ok"), "ok").when(F.col("fetched_at").isNotNull(), "failed")
    return fetching.report(c.select("task_id", "index"), c.select("task_id", "index", outcome.alias("outcome")).filter("outcome is not null")).select("task_id", "total", "failed", "skipped", "success")


@query(f"""with {E.CHAPTERS_SQL} select book_id, idx as "index" from chapters where not is_ok""")
def fetch_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.chapters(spark, sf_dir)
    return fetching.remaining(c.select("book_id", "index"), c)


@query(f"with plan as ({ORACLES['capture_plan']}) select book_id, count_if(action <> 'skip') as saved, count_if(action = 'skip') as skipped from plan group by book_id")
def capture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.capture_counts(capture_plan(spark, sf_dir))


@query()
def toc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.toc_links(parsed(E.table(spark, sf_dir, "pages"), "page_id", "url"))


@query("""with r as (select 'src' || (event_id % 7) as host, epoch_us(ts) // 1000000 as at_ms, event_id as request_id from events), k as (select *, row_number() over w as k from r window w as (partition by host order by at_ms, request_id)),
  s as (select host, k * 3000 + max(at_ms - k * 3000) over (partition by host order by at_ms, request_id) - at_ms as wait from k) select host, count(*) as requests, count_if(wait > 0) as waits, cast(sum(wait) as bigint) as wait_ms from s group by host""")
def pacing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.table(spark, sf_dir, "events")
    r = e.select(F.concat(F.lit("src"), (F.col("event_id") % 7).cast("string")).alias("host"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at_ms"), F.col("event_id").alias("request_id"))
    return fetching.pacing_stats(fetching.paced(r))
