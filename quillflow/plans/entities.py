"""Entities as views of the star schema: orders are books, events reading sessions and positions, conversations and order lines chapters.

Each view is a plain projection or join, so filters on a query reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions.text import char_count, content_hash
from quillflow.schemas import CHECK_MODES, FINISHED, FOLLOWING, READING, UNREAD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same books in SQL, for the oracles.
BOOKS_SQL = f"""
books as (
  select cast(o_orderkey as varchar) as book_id, 'Order ' || cast(o_orderkey % 997 as varchar) as title, c_name as author, n_name as source_site,
    c_mktsegment as tag1, o_orderpriority as tag2, cast(o_orderkey % 50 as integer) as total_chapters, cast(o_custkey % 60 as integer) as read_raw,
    cast(case when o_orderkey % 7 = 0 then o_orderkey % 5 else 0 end as integer) as new_chapters,
    case o_orderstatus when 'F' then '{FINISHED}' when 'P' then '{FOLLOWING}' else case when o_orderkey % 2 = 0 then '{READING}' else '{UNREAD}' end end as status,
    case when o_orderkey % 3 = 0 then null else o_orderdate end as last_read_at, o_orderdate as updated_at,
    case when o_orderkey % 4 = 0 then null else 'http://' || lower(replace(n_name, ' ', '-')) || '.example.com/' || cast(o_orderkey as varchar) end as toc_url,
    case o_orderkey % 4 when 0 then '{CHECK_MODES[0]}' when 1 then '{CHECK_MODES[1]}' when 2 then '{CHECK_MODES[2]}' else '{CHECK_MODES[3]}' end as check_mode,
    case when o_orderkey % 5 = 0 then null else o_orderdate end as next_check_at
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book an order: status by order status, source and author by customer."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", FINISHED).when(F.col("o_orderstatus") == "P", FOLLOWING).when(k % 2 == 0, READING).otherwise(UNREAD)
    total = (k % 50).cast("int")
    url = F.concat(F.lit("http://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example.com/"), k.cast("string"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.cast("string").alias("book_id"), F.concat(F.lit("Order "), (k % 997).cast("string")).alias("title"), F.col("c_name").alias("author"), F.col("n_name").alias("source_site"),
        F.array("c_mktsegment", "o_orderpriority").alias("tags"), total.alias("total_chapters"), F.least((F.col("o_custkey") % 60).cast("int"), total).alias("read_chapters"),
        F.when(k % 7 == 0, k % 5).otherwise(0).cast("int").alias("new_chapters"), status.alias("status"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("last_read_at"),
        F.col("o_orderdate").alias("updatedAt"), F.col("o_orderdate").alias("created_at"), F.when(k % 4 != 0, url).alias("toc_url"), F.element_at(F.array(*map(F.lit, CHECK_MODES)), (k % 4 + 1).cast("int")).alias("check_mode"),
        F.when(k % 5 != 0, F.col("o_orderdate")).alias("next_check_at"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading session an event, of value thousandths of a second... in milliseconds."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("book_id"), F.col("ts").alias("started_at"), F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("duration_ms"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")


SESSIONS_SQL = "sessions as (select cast(user_id as varchar) as book_id, ts as started_at, cast(floor(value * 1000 + 0.5) as bigint) as duration_ms, strftime(ts, '%Y-%m-%d') as day, event_id from events)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reported reading position (one an event), of books numbered as orders are."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("book_id"), (i % 60 + 1).cast("int").alias("chapter_index"), (i * 37 % 500).cast("int").alias("char_offset"), ((i % 101) / 100.0).alias("chapter_ratio"),
        ((i % 97) / 96.0).alias("percent"), F.col("ts").alias("updated_at"), "event_id",
    )


POSITIONS_SQL = """positions as (select cast(user_id as varchar) as book_id, cast(event_id % 60 + 1 as integer) as chapter_index, cast(event_id * 37 % 500 as integer) as char_offset,
  (event_id % 101) / 100.0::double as chapter_ratio, (event_id % 97) / 96.0::double as percent, ts as updated_at, event_id from events)"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book a conversation, one chapter a turn; turns of index divisible by 5 lack their text or its success."""
    c = table(spark, sf_dir, "conversations")
    index = (F.col("turn") + 1).cast("int")
    text = F.when(index % 5 != 0, F.col("text")).otherwise(F.lit(""))
    return c.select(
        F.col("conv_id").cast("string").alias("book_id"), index.alias("index"), F.concat(F.lit("Chapter "), (F.col("turn") + 1 + F.when(F.col("turn") >= 6, 1).otherwise(0)).cast("string"), F.lit(" "), F.col("role")).alias("title"), text.alias("content"),
        char_count(text).alias("char_count"), content_hash(text).alias("content_hash"), (index % 5 != 0).alias("is_ok"), F.when(index % 2 == 0, F.lit("2024-01-01")).cast("timestamp_ntz").alias("fetched_at"), F.lit("import").alias("origin"),
    )


#: White space of functions.text in the other engine's pattern language.
RE2_WS = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
CHAPTERS_SQL = f"""chapters as (select *, length(regexp_replace(content, '{RE2_WS}+', '', 'g')) as char_count, sha1(regexp_replace(content, '{RE2_WS}+', '', 'g')) as content_hash from (
  select cast(conv_id as varchar) as book_id, cast(turn + 1 as integer) as idx, 'Chapter ' || cast(turn + 1 + case when turn >= 6 then 1 else 0 end as varchar) || ' ' || role as title,
    case when (turn + 1) % 5 <> 0 then text else '' end as content, (turn + 1) % 5 <> 0 as is_ok, case when (turn + 1) % 2 = 0 then timestamp '2024-01-01' end as fetched_at from conversations))"""


def line_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book an order, one chapter an order line, numbered as lines are (with gaps and repeats), in a total order."""
    li = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")]
    return li.select(
        F.col("l_orderkey").cast("string").alias("book_id"), F.struct(*order).alias("position"), F.concat(F.lit("Chapter "), F.col("l_linenumber").cast("string")).alias("title"),
        F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("char_count"), (F.col("l_linestatus") == "F").alias("is_ok"),
        F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("fetched_at"), F.sha1(F.col("l_partkey").cast("string")).alias("content_hash"), "l_shipdate", "l_linenumber", "l_partkey",
    )


LINES_SQL = """lines as (select cast(l_orderkey as varchar) as book_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos,
  l_linenumber as num, 'Chapter ' || cast(l_linenumber as varchar) as title, case when l_returnflag = 'R' then 0 else cast(l_quantity as integer) end as char_count, l_linestatus = 'F' as is_ok,
  case when l_returnflag = 'A' then l_shipdate end as fetched_at, sha1(cast(l_partkey as varchar)) as content_hash, l_shipdate from lineitem)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book a part: its name as title, its brand as author."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_size").alias("total_chapters"), F.col("p_partkey").alias("position"))


def array_text(c: Column) -> Column:
    """An array of texts as one, for results that are compared as scalars."""
    return F.array_join(c, "|")
