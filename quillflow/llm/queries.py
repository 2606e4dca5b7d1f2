"""The queries that apply the operators to whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import classifier, decontamination, language_model, lines, mixing, quality_rules, repair, sharding, simhash, substring, toxicity, urls, whitening

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8)
    return found.withColumn("similarity", F.round("similarity", 6))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), order=2, backoff=0.4)
    return scored.withColumn("score", F.round("score", 6))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), "allow")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels").filter(remainder(4) != 2), per_class=1500)
    scored = classifier.score(docs, model, "doc_id")
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.cut_repeats(table(spark, sf_dir, "documents"), length=13, seed=5)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stratum="lang", limit=0.02, level=0.05)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


def remainder(n: int) -> Column:
    """crc32 of the id's text, modulo n: what holds a labelled row out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def toxic_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Grammar:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_grammar(spark, docs, sf_dir), "doc_id")
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_shared_lines(table(spark, sf_dir, "documents"), least=40, documents=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.components_of(table(spark, sf_dir, "embeddings"), "vec_id", scale=1024, shift=100_000, most=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_byte_shards, op3_decontamination, op4_language_model, op5_url_filter, op6_simhash_dedup, op7_quality_classifier, op8_substring_dedup, op9_quality_rules, op10_toxicity, op11_line_dedup, op12_conversation_repair, op13_embedding_whitening)}


def _repair_sql() -> str:
    """SQL of op12. A state's best rest of a conversation is a text, its cost in eight digits and then its letters, so the lesser of two is the better one."""
    then, last = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}
    plus = lambda cost, letters, v: f"(lpad(cast(cast({v}[1:8] as integer) + {cost} as varchar), 8, '0') || '{letters}' || {v}[9:])"
    takes = []
    for s in range(4):
        keeps = [(i, t) for i, t in (("s", 1), ("u", 2), ("a", 3)) if (s, t) in ((0, 1), (0, 2), (1, 2), (2, 3), (3, 2))]
        kept = " ".join(f"when '{i}' then {plus('late', 'K', f'v{t}')}" for i, t in keeps)
        takes.append(f"least({plus(3, 'D', f'v{s}')}, case when not must then case initial {kept} end end, case when not must then {plus('2 + late', 'R', f'v{then[s]}')} end) as t{s}")
    puts = ", ".join(f"least(t{s}, {plus(2, 'I', f't{then[s]}')}, {plus(4, 'II', f't{then[then[s]]}')}) as v{s}" for s in range(4))
    asked = "case state " + " ".join(f"when {s} then '{r}'" for s, r in last.items()) + " end"
    after = "case when letter = 'D' then state when letter = 'K' and initial = 's' then 1 when state = 2 then 3 else 2 end"
    return rf"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
bits as (select *, flatten(list_transform(range(1, length(name) + 1), lambda i: [cast(ascii(name[i]) as bigint), 0, 0, 0, 0, 0, 0, 0])) as b from raw),
kinds as (select *, xor(list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295), 4294967295) % 20 as kind from bits),
damaged as (select conv_id, turn, md5(role || ':' || text) as tie, copy, case when kind = 4 then 'user' else role end as role,
  case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, (select unnest([0, 1]) as copy) where kind <> 0 and (copy = 0 or kind = 3)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, tie, copy) as n, regexp_replace(text, '[ 	-
]+$', '') as bare from damaged),
seen as (select *, bare = '' as blank, bare <> '' and row_number() over (partition by conv_id, role, text order by n) > 1 as duplicate from numbered),
rows as (select conv_id, n, turn, role, text, role[1:1] as initial, blank, duplicate, blank or duplicate as must, cast(not blank and not duplicate and not regexp_matches(bare, '[.!?]$') as integer) as late from seen),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, sum(late) as truncated, max(n) as size from rows group by conv_id),
pairs as (select conv_id, lag(initial) over (partition by conv_id order by n) || initial as pair from rows),
illegals as (select conv_id, count(*) as illegal from pairs where pair is not null and pair not in ('su', 'ua', 'au') group by conv_id),
best as (select conv_id, size as i, '00000000' as v0, '00000004II' as v1, '00000002I' as v2, '00000000' as v3 from counts
  union all select conv_id, i, {puts} from (select b.conv_id, i - 1 as i, {", ".join(takes)} from best b join rows r on b.conv_id is not distinct from r.conv_id and r.n = b.i)),
audits as (select conv_id, cast(v0[1:8] as bigint) as cost, v0[9:] as audit from best where i = 0),
walk as (select conv_id, audit, 0 as step, 0 as i, 0 as state, cast(null as varchar) as body from audits
  union all select conv_id, audit, step + 1, i + cast(letter <> 'I' as integer), {after},
    case when letter = 'D' then body else coalesce(body || chr(10), '') || case letter when 'K' then role || ':' || text when 'R' then {asked} || ':' || text else {asked} || ':' end end
  from (select w.*, r.role, r.text, r.initial, w.audit[w.step + 1] as letter from walk w left join rows r on w.conv_id is not distinct from r.conv_id and r.n = w.i + 1 where w.step < length(w.audit)))
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(w.audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id left join illegals l on o.conv_id is not distinct from l.conv_id
left join audits a on o.conv_id is not distinct from a.conv_id left join walk w on o.conv_id is not distinct from w.conv_id and w.step = length(w.audit)
"""


ORACLES = {
    "op12_conversation_repair": _repair_sql(),
    "op5_url_filter": r"""
with rules(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest as (select page_id, row_number() over () as row_no, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select page_id, row_no, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
ranked as (select p.*, rh || rp as rule, rv, row_number() over (partition by row_no order by length(rh || rp) desc nulls last, length(rh) desc, rv desc) as n
  from parts p left join rules on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from ranked where n = 1
""",
    "op8_substring_dedup": r"""
with docs as (select doc_id, row_number() over () as row_no, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select doc_id, row_no, words, unnest(generate_series(1, greatest(len(words) - 12, 0))) as s from docs where len(words) >= 13),
windows as (select doc_id, row_no, s, sha256(array_to_string(words[s : s + 12], ' ')) as w from starts),
first as (select w, min(doc_id) as least from windows group by w),
gone as (select distinct row_no, unnest(generate_series(s, s + 12)) as at from windows join first using (w) where least < doc_id),
placed as (select doc_id, row_no, unnest(words) as word, generate_subscripts(words, 1) as at from docs),
kept as (select p.row_no, count(*) as n_kept, string_agg(p.word, ' ' order by p.at) as body from placed p left join gone g on p.row_no = g.row_no and p.at = g.at where g.at is null group by p.row_no)
select doc_id, len(words) as n_words, len(words) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256 from docs left join kept using (row_no)
""",
    "op11_line_dedup": r"""
with docs as (select doc_id, row_number() over () as row_no, string_split(coalesce(text, ''), chr(10)) as lines from documents),
placed as (select doc_id, row_no, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
keyed as (select doc_id, row_no, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from placed),
shared as (select key, max(doc_id) as last from keyed where length(key) >= 40 group by key
  having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 5),
judged as (select k.*, last is not null and (doc_id is null or doc_id < last) as goes from keyed k left join shared using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where goes) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not goes), '')) as kept_sha256
from judged group by row_no
""",
}
