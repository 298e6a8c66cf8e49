"""Conversation memory and transcript queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.operators import memory as mem
from tarn.plans.registry import query
from tarn.plans.retrieval import cut_sql
from tarn.sources.tables import MESSAGES_SQL, messages, table

NOW = dt.datetime(2024, 3, 13, 15, 30)

TURNS = MESSAGES_SQL + """,
    o as (select *, coalesce(lag(role) over (partition by conversation_id order by position), '') as before from m),
    t0 as (select *, sum(case when role = 'user' or (role = 'assistant' and before not in ('user', 'assistant')) then 1 else 0 end)
                  over (partition by conversation_id order by position) - 1 as turn_no from o),
    t as (select * from t0 where role in ('user', 'assistant'))"""
UNITS = TURNS + """,
    u as (select conversation_id, turn_no, list(message_id order by position) as ids, count(distinct context_mode) as modes, min(started) as started_at, max(started) as ended_at,
                 string_agg(case role when 'user' then 'User' else 'Assistant' end || ' [' || upper(left(context_mode, 1)) || context_mode[2:] || ']:' || chr(10) || content, chr(10) || chr(10) order by position) as unit_text
          from (select *, created_at as started from t) group by 1, 2)"""


@query(f"with {TURNS} select conversation_id, position, turn_no::bigint as turn_no from t")
def mem_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-1."""
    return mem.turns(messages(spark, sf_dir), "conversation_id", "position", "role").select("conversation_id", "position", "turn_no")


@query(f"with {UNITS} select conversation_id, turn_no::bigint as turn_no, array_to_string(ids, ',') as ids, modes, started_at, ended_at, sha256(unit_text) as fingerprint from u")
def mem_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-2."""
    u = mem.units(messages(spark, sf_dir))
    return u.select("conversation_id", "turn_no", F.array_join("message_ids", ",").alias("ids"), F.size("context_modes").cast("long").alias("modes"), "started_at", "ended_at", "fingerprint")


@query(f"with {MESSAGES_SQL} select message_id, upper(left(role, 1)) || role[2:] || ' [' || upper(left(context_mode, 1)) || context_mode[2:] || ']:' || chr(10) || content as text from m where role <> 'system'")
def mem_role_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11."""
    return messages(spark, sf_dir).where("role <> 'system'").select("message_id", mem.role_text(F.col("role"), F.col("context_mode"), F.col("content")).alias("text"))


@query(f"with {MESSAGES_SQL} select conversation_id, sha256(string_agg(sha256(message_id || '|' || role || '|' || content), ',' order by position)) as fingerprint from m group by 1")
def mem_corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    return mem.corpus_fingerprint(messages(spark, sf_dir), ["conversation_id"], "position")


@query(f"""with {MESSAGES_SQL}, a as (select conversation_id, sha256(string_agg(sha256(message_id || '|' || role || '|' || content), ',' order by position)) as now from m group by 1),
    b as (select conversation_id, sha256(string_agg(sha256(message_id || '|' || role || '|' || content), ',' order by position)) as old from m where not (conversation_id % 9 = 0 and position = 1) group by 1)
    select conversation_id, coalesce(now <> old, true) as stale from a left join b using (conversation_id)""")
def mem_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-4: an index built before one message came in is stale."""
    m = messages(spark, sf_dir)
    old = mem.corpus_fingerprint(m.where("not (conversation_id % 9 = 0 and position = 1)"), ["conversation_id"], "position").withColumnRenamed("fingerprint", "old")
    now = mem.corpus_fingerprint(m, ["conversation_id"], "position")
    return now.join(old, "conversation_id", "left").select("conversation_id", F.coalesce(F.col("fingerprint") != F.col("old"), F.lit(True)).alias("stale"))


@query(f"""with {UNITS}, k as (select conversation_id || ':' || turn_no as unit, sha256(unit_text) as fp, conversation_id from u)
    select conversation_id, count(*) filter (hash_ok) as reused, count(*) filter (not hash_ok) as pending from
    (select *, not (conversation_id % 4 = 0) and not (conversation_id % 5 = 0) as hash_ok from k) group by 1""")
def mem_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-3: against an index without every fourth conversation, and with another model for every fifth."""
    u = mem.units(messages(spark, sf_dir)).select(F.concat_ws(":", "conversation_id", "turn_no").alias("unit"), "conversation_id", "fingerprint", F.lit("model-a").alias("model"))
    old = u.where("conversation_id % 4 <> 0").withColumn("model", F.when(F.col("conversation_id") % 5 == 0, "model-b").otherwise("model-a")).withColumn("embedding", F.array(F.lit(1.0)))
    found = mem.reuse(u, old.drop("conversation_id"), "unit", "fingerprint", "model")
    return found.groupBy("conversation_id").agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("pending"))


PHRASES = ["today", "what was said yesterday", "three days ago", "2 weeks ago", "this week", "last week", "this month", "last month", "this year", "last year", "in february 2024", "last march", "nothing"]
WINDOWS = """(values ('today', '2024-03-13', '2024-03-13'), ('what was said yesterday', '2024-03-12', '2024-03-12'), ('three days ago', '2024-03-10', '2024-03-10'), ('2 weeks ago', '2024-02-28', '2024-03-13'),
    ('this week', '2024-03-11', '2024-03-13'), ('last week', '2024-03-04', '2024-03-10'), ('this month', '2024-03-01', '2024-03-13'), ('last month', '2024-02-01', '2024-02-29'), ('this year', '2024-01-01', '2024-03-13'),
    ('last year', '2023-01-01', '2023-12-31'), ('in february 2024', '2024-02-01', '2024-02-29'), ('last march', '2023-03-01', '2023-03-31'), ('nothing', '0001-01-01', '9999-12-31')) w(phrase, a, b)"""


@query(f"""with {UNITS} select phrase, count(u.turn_no) as units from {WINDOWS} left join u on (started_at >= a::timestamp and started_at < b::timestamp + interval 1 day) or (ended_at >= a::timestamp and ended_at < b::timestamp + interval 1 day) or phrase = 'nothing' group by 1""")
def mem_temporal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1, FLT-13: one pass, a conditional count per phrase."""
    u = mem.units(messages(spark, sf_dir))
    counts = u.agg(*[F.count_if(mem.in_window(F.col("started_at"), F.col("ended_at"), mem.window_of(p, NOW))).alias(p) for p in PHRASES])
    return counts.unpivot([], PHRASES, "phrase", "units")


EXCLUDED = [f"{c}:{t}" for c in range(3) for t in range(2)]


@query(f"with {UNITS} select conversation_id, turn_no::bigint as turn_no from u where not list_has_any(ids, [{', '.join(repr(x) for x in EXCLUDED)}])")
def mem_exclude_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-7."""
    return mem.units(messages(spark, sf_dir)).where(~F.arrays_overlap("message_ids", F.array(*map(F.lit, EXCLUDED)))).select("conversation_id", "turn_no")


ASKED = "What was my Tion Reau project?"
HAY = TURNS + """,
    h as (select conversation_id, turn_no, lower(string_agg(content, chr(10) order by position)) as haystack,
                 coalesce(lower(string_agg(case when role = 'user' then content end, chr(10) order by position)), '') as user_haystack from t group by 1, 2)"""


def _haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-8."""
    t = mem.turns(messages(spark, sf_dir), "conversation_id", "position", "role")
    item = F.struct("position", "content", "role")
    g = t.groupBy("conversation_id", "turn_no").agg(F.array_sort(F.collect_list(item)).alias("m"))
    text = lambda a: F.lower(F.array_join(F.transform(a, lambda x: x["content"]), "\n"))
    return g.select("conversation_id", "turn_no", text(F.col("m")).alias("haystack"), text(F.filter("m", lambda x: x["role"] == "user")).alias("user_haystack"))


@query(f"with {HAY} select conversation_id, turn_no::bigint as turn_no, contains(haystack, 'tion') and contains(haystack, 'the ') as hit from h")
def mem_exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-8, MEM-9: substring search in lower-cased turns."""
    return _haystacks(spark, sf_dir).select("conversation_id", "turn_no", (F.contains("haystack", F.lit("tion")) & F.contains("haystack", F.lit("the "))).alias("hit"))


@query(f"""with {HAY}, p as (select *, contains(haystack, 'reau') as any_hit, contains(user_haystack, 'reau') as user_hit, trim(regexp_replace(user_haystack, '\\s+', ' ', 'g')) as q from h),
    a as (select *, q <> '' and length(q) <= 120 and regexp_matches(q, '^(what|who|where|when|why|how|tell me about|do you remember)\\b') and contains(q, 'reau') as asked from p)
    select conversation_id, turn_no::bigint as turn_no, round(case when haystack = '' then 0 else case when any_hit then 0.02 else 0 end end, 6) as boost from a""")
def mem_phrase_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-10 for a weak one-word question: only its small weight can count."""
    boost = mem.phrase_boost(F.col("haystack"), F.col("user_haystack"), "what was my reau?", True)
    return _haystacks(spark, sf_dir).select("conversation_id", "turn_no", F.round(boost, 6).alias("boost"))


@query(f"""with {UNITS}, s as (select conversation_id, turn_no, (conversation_id * 31 + turn_no * 17) % 101 / 100.0::double as score from u),
    r as (select *, row_number() over (partition by conversation_id order by score desc, turn_no) as rn from s) select conversation_id, turn_no::bigint as turn_no, round(score, 6) as score from r where rn = 1""")
def mem_best_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2."""
    u = mem.units(messages(spark, sf_dir)).select("conversation_id", "turn_no", ((F.col("conversation_id") * 31 + F.col("turn_no") * 17) % 101 / 100.0).alias("score"))
    return mem.best_per_unit(u, "conversation_id", F.desc("score"), "turn_no").select("conversation_id", "turn_no", F.round("score", 6).alias("score"))


@query(f"""with {UNITS}, n as (select conversation_id, turn_no, unit_text, row_number() over (partition by conversation_id order by turn_no) as n from u), n5 as (select * from n where n <= 5),
    h as (select *, left(unit_text, 700) as head from n5),
    p as (select *, length(head) - length(list_last(string_split(head, chr(10) || chr(10)))) - 2 as pos from h),
    x as (select conversation_id, turn_no, n, case when n = 1 and length(unit_text) > 700 then case when pos >= 350 then left(unit_text, pos::bigint) else head end else unit_text end as t from p),
    y as (select *, sum(length(t) + case when n > 1 then 2 else 0 end) over (partition by conversation_id order by n) as used from x)
    select conversation_id, turn_no::bigint as turn_no, used::bigint as used_chars from y where n = 1 or used <= 700""")
def mem_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CF-6, a budget of 700 characters for each conversation."""
    u = mem.units(messages(spark, sf_dir)).select("conversation_id", "turn_no", "unit_text")
    return mem.context_budget(u, "turn_no", "unit_text", 700, 5, by=["conversation_id"]).select("conversation_id", "turn_no", "used_chars")


@query(f"""with {HAY}, un as (select conversation_id, turn_no, min(created_at) as a, max(created_at) as b, list(message_id) as ids from t group by 1, 2),
    s as (select h.conversation_id, h.turn_no, (h.conversation_id * 37 + h.turn_no * 11) % 97 / 96.0::double as similarity, haystack from h join un using (conversation_id, turn_no)
          where ((a >= timestamp '2024-02-01' and a < timestamp '2024-03-01') or (b >= timestamp '2024-02-01' and b < timestamp '2024-03-01'))),
    g as (select *, similarity + case when contains(haystack, 'tion') then 0.02 else 0 end as score from s),
    r as (select *, row_number() over (partition by conversation_id order by score desc, similarity desc, turn_no) as rn from g),
    b as (select * from r where rn = 1 order by score desc, similarity desc, conversation_id limit 5),
    k as (select *, row_number() over (order by score desc, similarity desc, conversation_id) as rank from b)
    select conversation_id as unit, turn_no::bigint as chunk, round(score, 6) as score, rank from k""")
def mem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-12: a question with a time phrase and a weak word; similarities are made up, excerpts short."""
    u = mem.units(messages(spark, sf_dir)).join(_haystacks(spark, sf_dir), ["conversation_id", "turn_no"])
    chunks = u.select(
        F.col("conversation_id").alias("unit"), F.col("turn_no").alias("chunk"), ((F.col("conversation_id") * 37 + F.col("turn_no") * 11) % 97 / 96.0).alias("similarity"),
        "message_ids", "started_at", "ended_at", "haystack", "user_haystack", F.left("unit_text", F.lit(100)).alias("excerpt"),
    )
    found = mem.search(chunks, "what was tion last month", dt.datetime(2024, 3, 13))
    return found.select("unit", "chunk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {TURNS}, s as (select conversation_id, turn_no, message_id, position, content, case when conversation_id % 6 = 0 and position = 0 then length(content) + 5 else least(50, length(content)) end as stop from t)
    select conversation_id, turn_no::bigint as turn_no, string_agg(left(content, stop::bigint), chr(10) || chr(10) order by position) as excerpt from s group by 1, 2 having bool_and(stop <= length(content))""")
def mem_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-5: the first 50 characters of every message; a segment beyond its message drops the chunk."""
    m = messages(spark, sf_dir)
    t = mem.turns(m, "conversation_id", "position", "role")
    stop = F.when((F.col("conversation_id") % 6 == 0) & (F.col("position") == 0), F.length("content") + 5).otherwise(F.least(F.lit(50), F.length("content")))
    segment = F.struct("position", "conversation_id", "message_id", F.lit(0).alias("start_char"), stop.alias("end_char"))
    c = t.groupBy("conversation_id", "turn_no").agg(F.array_sort(F.collect_list(segment)).alias("segments")).select(F.struct("conversation_id", "turn_no").alias("key"), "segments")
    return mem.excerpts(c, m, "key").select("key.*", "excerpt")


@query("""with r as (select l_orderkey as file, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as rank, (l_partkey % 60)::int as a, (l_partkey % 60 + l_linenumber * 3)::int as b from lineitem where l_linenumber <= 2),
    p as (select file, max(case when rank = 1 then a end) as a1, max(case when rank = 1 then b end) as b1, max(case when rank = 2 then a end) as a2, max(case when rank = 2 then b end) as b2, count(*) as n from r group by 1 having count(*) <= 2)
    select file, 0 as range_no, case when n = 2 and a1 <= b2 and a2 <= b1 then least(a1, a2) else a1 end as range_start, case when n = 2 and a1 <= b2 and a2 <= b1 then greatest(b1, b2) else b1 end as range_end from p
    union all select file, 1, a2, b2 from p where n = 2 and not (a1 <= b2 and a2 <= b1)""")
def src_merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14 for files with up to two cited ranges; longer lists are tested against a plain loop."""
    item = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    w = Window.partitionBy("l_orderkey")
    r = item.select(F.col("l_orderkey").alias("file"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey")).alias("rank"), (F.col("l_partkey") % 60).alias("a"), (F.col("l_partkey") % 60 + F.col("l_linenumber") * 3).alias("b"), F.count("*").over(w).alias("n"))
    return mem.merge_ranges(r.where("n <= 2"), "file", "rank", "a", "b")


@query("""with recursive r as (select l_orderkey // 16 as file, row_number() over (partition by l_orderkey // 16 order by l_orderkey, l_linenumber, l_partkey) as n, l_partkey * 7 % 1000 as a, l_partkey * 7 % 1000 + l_suppkey % 9 + l_linenumber * 3 as b from lineitem),
    s as (select file, n, [struct_pack(a := a, b := b)] as kept from r where n = 1 union all
        select file, n, case when spot > 0 then list_concat(kept[:spot - 1], [struct_pack(a := least(kept[spot].a, a), b := greatest(kept[spot].b, b))], kept[spot + 1:]) else list_append(kept, struct_pack(a := a, b := b)) end
        from (select s.file, r.n, kept, r.a, r.b, coalesce(list_position(list_transform(kept, lambda k: k.a <= r.b and r.a <= k.b), true), 0) as spot from s join r on r.file = s.file and r.n = s.n + 1)),
    l as (select * from s qualify row_number() over (partition by file order by n desc) = 1), f as (select file, unnest(kept) as k, generate_subscripts(kept, 1) - 1 as range_no from l)
    select file, range_no::int as range_no, k.a::int as range_start, k.b::int as range_end from f""")
def src_merge_ranges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, SEQ-4: all line items as cited ranges, up to a hundred of a file."""
    item = table(spark, sf_dir, "lineitem")
    a = F.col("l_partkey") * 7 % 1000
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("rank")
    r = item.select(F.expr("l_orderkey div 16").alias("file"), rank, a.alias("a"), (a + F.col("l_suppkey") % 9 + F.col("l_linenumber") * 3).alias("b"))
    return mem.merge_ranges(r, "file", "rank", "a", "b")


@query(f"""with {MESSAGES_SQL}, b as (select * from m where conversation_id % 3 = 0 union all select * from m where conversation_id % 6 = 0)
    select message_id, min(role) as role from b where message_id not in (select message_id from m where position < 2) group by 1""")
def tx_append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3: a batch with repeats, part of which is there already."""
    m = messages(spark, sf_dir)
    batch = m.where("conversation_id % 3 = 0").unionByName(m.where("conversation_id % 6 = 0"))
    return mem.append_new(m.where("position < 2"), batch, "message_id", "position").select("message_id", "role")


@query(f"""with {MESSAGES_SQL} select message_id, case when position = 1 then 'edited' else content end as content, case when position = 1 and conversation_id % 2 = 0 then null else 'pending' end as approval_status from m""")
def tx_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-5: contents are set, and approval states set to null where the patch says so."""
    m = messages(spark, sf_dir).select("message_id", "conversation_id", "content", "position", F.lit("pending").alias("approval_status"))
    patches = m.where("position = 1").select("message_id", F.lit("edited").alias("content"), F.lit(True).alias("set_content"), F.lit(None).cast("string").alias("approval_status"), (F.col("conversation_id") % 2 == 0).alias("set_approval_status"))
    return mem.patch(m, patches, "message_id", ["content", "approval_status"]).select("message_id", "content", "approval_status")


@query(f"with {MESSAGES_SQL} select conversation_id, min(created_at) as created_at, max(created_at) as ended_at, count(*) as message_count from m group by 1")
def tx_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17."""
    return messages(spark, sf_dir).groupBy("conversation_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("message_count"))


@query("""with h as (select conv_id, list({'role': role, 'text': text} order by turn) as items from conversations group by 1),
    x as (select conv_id, unnest(items) as item, unnest(range(0, len(items))) as i from h)
    select conv_id, 'migrated-' || i as message_id, item.role as role from x where item.role in ('user', 'assistant')""")
def tx_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: ids keep the place in the old list."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    x = c.select("conv_id", F.posexplode("items").alias("i", "item"))
    return x.where(F.col("item.role").isin("user", "assistant")).select("conv_id", F.concat(F.lit("migrated-"), "i").alias("message_id"), F.col("item.role").alias("role"))


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as place from conversations where role <> 'system'")
def tx_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, UI-7."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query(f"with {UNITS} select conversation_id, turn_no::bigint as turn_no, 0 as chunk_index, length(unit_text) as size from u where length(unit_text) <= 2000")
def chunk_turns_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-3: turns that fit are one chunk, as they are."""
    u = mem.units(messages(spark, sf_dir)).where(F.length("unit_text") <= 2000).withColumn("unit", F.struct("conversation_id", "turn_no"))
    from tarn.operators.chunking import turn_chunks

    c = turn_chunks(u.select(F.concat_ws(":", "conversation_id", "turn_no").alias("unit"), "unit_text"), "unit", "unit_text")
    return c.select(F.split_part("unit", F.lit(":"), F.lit(1)).cast("long").alias("conversation_id"), F.split_part("unit", F.lit(":"), F.lit(2)).cast("long").alias("turn_no"), "chunk_index", F.col("end_char").cast("long").alias("size"))


LONG_TURNS = "select conversation_id || ':' || turn_no::bigint as id, unit_text as t from u where length(unit_text) > 2000"


@query(f"with recursive {UNITS}, {cut_sql(LONG_TURNS, 2000, 250, True)}, every as (select id, t, idx, a, b from cuts where idx >= 0 union all select conversation_id || ':' || turn_no::bigint, unit_text, 0, 0, length(unit_text) from u where length(unit_text) <= 2000)" + """
    select id as unit, idx as chunk_index, a::int as start_char, b::int as end_char, sha256(substr(t, a + 1, b - a)) as digest from every""")
def chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-3; the SQL is recursive for turns that are cut."""
    from tarn.operators.chunking import turn_chunks

    u = mem.units(messages(spark, sf_dir)).select(F.concat_ws(":", "conversation_id", "turn_no").alias("unit"), "unit_text")
    return turn_chunks(u, "unit", "unit_text").select("unit", "chunk_index", "start_char", "end_char", F.sha2("content", 256).alias("digest"))
