"""Queries of the symbol index over source texts made from the parts, with SQL that extracts everything from the texts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import compose, symbol_index, xref
from tarn.plans.registry import query
from tarn.sources.tables import CODE_CORPUS_SQL, code_corpus


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
ROUTE = r"/api/[A-Za-z0-9][A-Za-z0-9_/-]*"
IMPL = r"regexp_matches(file_path, '\.(js|jsx|ts|tsx|py)$')"
STOP = ", ".join(_quoted(w) for w in sorted({*xref.KEYWORDS, *xref.COMMON}))


def _named(role: str, text: str) -> str:
    """SQL for the names that play a role in a text, form by form."""
    found = []
    for pattern, captures in xref.FORMS[role]:
        hits = f"regexp_extract_all({text}, {_quoted(pattern)}, 1)"
        found.append(hits if captures == "name" else f"list_filter(flatten(list_transform({hits}, lambda h: regexp_extract_all(h, '{IDENTIFIER}'))), lambda w: w not in ('as', 'type'))")
    return f"list_concat({', '.join(found)})" if len(found) > 1 else found[0]


def _bare() -> str:
    out = "content"
    for pattern, to in (
        (r"/\*[\s\S]*?\*/", " "),
        (r"(?m)^\s*\*.*$", " "),
        (r"(?m)(^|[^:])//.*$", r"\1"),
        (r"'(?:\\.|[^'\\])*'", "''"),
        (r'"(?:\\.|[^"\\])*"', '""'),
        (r"`(?:\\.|[^`\\])*`", "``"),
    ):
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return out


SHAPED = "contains(w, '$') or contains(w, '_') and regexp_matches(w, '[A-Za-z]') or regexp_matches(w, '[a-z][A-Z]') or regexp_matches(w, '[A-Z][a-z]+[A-Z]')"
QUOTED_ROUTE = _quoted(f"['\"`]({ROUTE})['\"`]")
LOGGED_ROUTE = _quoted(rf"(?i)['\"`](?:GET|POST|PUT|PATCH|DELETE)\s+({ROUTE})")

#: What each chunk refers to (outs) and shows (ranked), from the texts of c.
INDEX = f"""
    bare as materialized (select *, {_bare()} as bare, lower(file_path) as file, {IMPL} as impl from c),
    roles as materialized (select *, {_named("declared", "content")} as declared, {_named("imported", "content")} as imported, {_named("called", "content")} as called,
        list_concat({_named("declared", "content")}, {_named("imported", "content")}, {_named("called", "bare")}, list_filter(regexp_extract_all(bare, '{IDENTIFIER}'), lambda w: {SHAPED})) as spelled,
        list_concat(regexp_extract_all(content, {QUOTED_ROUTE}, 1), regexp_extract_all(content, {LOGGED_ROUTE}, 1)) as told from bare),
    named as (select chunk_id, symbol, min(p) as p from (select chunk_id, unnest(spelled) as symbol, generate_subscripts(spelled, 1) as p from roles) where length(symbol) >= 3 and symbol not in ({STOP}) and lower(symbol) not in ({STOP}) group by all),
    routed as (select chunk_id, regexp_replace(symbol, '/+$', '') as symbol, min(p) as p from (select chunk_id, unnest(told) as symbol, generate_subscripts(told, 1) as p from roles) group by all having length(regexp_replace(symbol, '/+$', '')) > 4),
    refers as (select *, 'n' as kind, 16 as most from named union all select *, 'r', 8 from routed),
    outs as materialized (select chunk_id, kind, symbol, row_number() over (partition by chunk_id, kind order by p) - 1 as round, most from refers qualify round < most),
    posts as (
        select chunk_id, file, impl, symbol, case when list_contains(declared, symbol) then 'definition' when list_contains(imported, symbol) then 'import' when list_contains(called, symbol) then 'call' else 'reference' end as cat, 'n' as kind
        from (select chunk_id, file, impl, declared, imported, called, unnest(list_distinct(regexp_extract_all(content, '{IDENTIFIER}'))) as symbol from roles)
        union all select chunk_id, file, impl, unnest(list_distinct(regexp_extract_all(content, '{ROUTE}'))), 'route', 'r' from roles),
    ranked as materialized (select *, case when cat = 'definition' and regexp_matches(symbol, '^[a-z][a-z0-9]*$') then 3 when cat = 'definition' then 0 when cat in ('call', 'route') then 1 when cat = 'import' then 2 else 3 end as rank from posts)"""


def _hop(n: int, unseen: str) -> str:
    """One hop from ``seed{n}``: the names asked for (want{n}) and the best match of each chunk (best{n})."""
    return f""",
    first{n} as (select kind, symbol, round, o from outs join seed{n} using (chunk_id) qualify row_number() over (partition by kind, symbol order by round, o) = 1),
    live{n} as (select *, dense_rank() over (partition by kind order by round) - 1 as d from first{n}),
    want{n} as materialized (select kind, symbol, position from (select *, row_number() over (partition by kind order by round, o) as position from live{n} where d = round) where position <= 40 {unseen}),
    hit{n} as (select r.*, position from ranked r join want{n} w on w.symbol = r.symbol and w.kind = r.kind where chunk_id not in (select chunk_id from seed0)),
    one{n} as (select * from hit{n} qualify row_number() over (partition by chunk_id, kind order by case when kind = 'n' then rank else 0 end, position) = 1),
    best{n} as materialized (select *, file not in (select file from bare join seed{n} using (chunk_id)) as cross_file from one{n} qualify row_number() over (partition by chunk_id order by rank, symbol) = 1)"""


SEARCH = (
    INDEX
    + _hop(0, "")
    + """,
    seed1 as materialized (select chunk_id, row_number() over (order by chunk_id) as o from (select chunk_id from best0 where impl and cat in ('definition', 'call', 'route') order by rank, chunk_id limit 12))"""
    + _hop(1, "and symbol not in (select symbol from want0)")
    + """,
    hops as materialized (select chunk_id, symbol, cat as raw_category, cross_file, 0 as hop from best0 union all select chunk_id, symbol, cat, cross_file, 1 from best1 where chunk_id not in (select chunk_id from best0))"""
)


@query(f"with {CODE_CORPUS_SQL}, {INDEX} select chunk_id, symbol, cat as raw_category, rank from ranked where kind = 'r' or length(symbol) >= 3")
def xref_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-2, XREF-3, XREF-6, XREF-7: every symbol and route of every chunk, with its evidence and rank."""
    return symbol_index.build(code_corpus(spark, sf_dir)).postings.select("chunk_id", "symbol", "raw_category", "rank")


@query(f"with {CODE_CORPUS_SQL}, seed0 as (select chunk_id, chunk_id as o from c order by chunk_id limit 3), {SEARCH} select * from hops")
def xref_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-8: two hops from three seeds, through the symbol index."""
    chunks = code_corpus(spark, sf_dir)
    seeds = [r["chunk_id"] for r in chunks.select("chunk_id").orderBy("chunk_id").limit(3).collect()]
    return symbol_index.expand(symbol_index.build(chunks), seeds)


OPTIONS = f"regexp_matches(content, '{IDENTIFIER}\\s*\\(\\s*\\{{') or regexp_matches(content, '{IDENTIFIER}\\s*\\([^)]*,\\s*\\{{')"
TYPES = r"""regexp_matches(file_path, '\.tsx?$') and regexp_matches(content, '(?:^|\n)\s*(?:export\s+)?(?:interface|type)\s+')
    and not regexp_matches(content, '(?:^|\n)\s*(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\b') and not regexp_matches(content, '(?:^|\n)\s*def\s+')"""


@query(f"""with {CODE_CORPUS_SQL}, sel as materialized (select *, {IMPL} as impl, {TYPES} as types, row_number() over (order by similarity desc, chunk_id) as place from c qualify place <= 8),
    seed0 as materialized (select chunk_id, place as o from sel where impl or not exists (select 1 from sel where impl)), {SEARCH},
    told0 as (select symbol, round, place from outs join sel using (chunk_id) where kind = 'r' qualify row_number() over (partition by symbol order by round, place) = 1),
    told as (select symbol from (select *, dense_rank() over (order by round) - 1 as d from told0) where d = round qualify row_number() over (order by round, place) <= 40),
    known as (select symbol from want0 where kind = 'n' and symbol in (select symbol from posts where cat = 'definition' and chunk_id in (select chunk_id from sel))),
    f as (select b.chunk_id, b.file, b.start_line, b.end_line, b.similarity, b.impl, {TYPES} as types, raw_category as raw, regexp_matches(symbol, '^[a-z][a-z0-9]*$') as weak, hop > 0 as h2, cross_file as crossf, symbol in (select symbol from known) as known, symbol in (select symbol from told) as rs,
        b.file in (select lower(file_path) from sel) as fs, {OPTIONS} as opt from hops join bare b using (chunk_id) where b.chunk_id not in (select chunk_id from sel)),
    g as (select *, case when raw = 'definition' and weak then 'reference' else raw end as cat from f),
    own as (select *, case cat when 'definition' then 120 when 'call' then 110 when 'route' then 110 when 'import' then 70 else 8 end * case when h2 then 0.5 else 1 end + case when crossf then 40 else 0 end + case when impl then 0 else -80 end + case when h2 then 0 else 50 end
        + case when not h2 and raw = 'definition' and not known then 60 else 0 end + case when raw = 'definition' and known then -55 else 0 end + case when raw = 'import' and known then -60 else 0 end
        + case when h2 and raw = 'call' and not weak then 110 else 0 end + case when not h2 and raw = 'call' and crossf and known and not weak then 110 else 0 end + case when raw = 'route' and crossf and rs then 110 else 0 end
        + case when fs and raw <> 'definition' then -80 else 0 end + case when not h2 and cat in ('call', 'reference') and opt then 110 else 0 end as score from g),
    pool as (select chunk_id, lower(file_path) as file, start_line, end_line, similarity, impl and not types as prot, case when types then 250 when not impl then 200 else 800 end + similarity as total, 'semantic' as origin from sel
        union all select chunk_id, file, start_line, end_line, similarity, false, case when not impl then 120 + similarity else least(790, 520 + score + similarity) end, 'xref' from own),
    capped as (select * from pool qualify row_number() over (partition by file order by prot desc, total desc, similarity desc, start_line, end_line) <= 2),
    chosen as (select chunk_id, origin, row_number() over (order by prot desc, total desc, similarity desc, file, start_line, end_line) as rank from capped qualify rank <= 16)
    select * from chosen union all select chunk_id, 'semantic', (select count(*) from chosen) + row_number() over (order by place) as rank from sel where (select count(*) from chosen) < 8 and chunk_id not in (select chunk_id from chosen) qualify rank <= 8""")
def xref_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-12: the eight best chunks widened to sixteen through the symbol index; a test holds it against plain Python too."""
    chunks = code_corpus(spark, sf_dir)
    best = chunks.orderBy(F.desc("similarity"), "chunk_id").limit(8)
    return compose.expand_results(best, chunks, 16).select("chunk_id", "origin", F.col("rank").cast("long").alias("rank"))
