"""Readers of the test tables and adapters to the entities of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Epoch milliseconds of the adapters' clock, 2024-01-01 UTC.
EPOCH_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript messages (DM-9) from ``conversations``; every conversation a day, every turn a minute."""
    c = table(spark, sf_dir, "conversations")
    modes = F.array(*map(F.lit, ("chat", "project", "file", "computer")))
    return c.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("position"),
        F.concat_ws(":", "conv_id", "turn").alias("message_id"),
        "role",
        F.col("text").alias("content"),
        F.element_at(modes, (F.col("conv_id") % 4 + 1).cast("int")).alias("context_mode"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(conv_id % 366 as int), 0, cast(turn as int), 0)").alias("created_at"),
    )


MESSAGES_SQL = """
    m as (select conv_id as conversation_id, turn as position, conv_id || ':' || turn as message_id, role, text as content,
                 ['chat', 'project', 'file', 'computer'][(conv_id % 4 + 1)::int] as context_mode,
                 timestamp '2024-01-01' + to_days((conv_id % 366)::int) + to_minutes(turn::int) as created_at
          from conversations)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory files (DM-4) from ``documents``: root by source, directory and extension by language."""
    d = table(spark, sf_dir, "documents")
    ext = F.create_map(*[F.lit(x) for kv in {"en": "txt", "fr": "md", "de": "pdf", "es": "bin"}.items() for x in kv])[F.col("lang")]
    name = F.concat(F.when(F.col("doc_id") % 97 == 0, ".env").otherwise("file_"), F.col("doc_id"), F.lit("."), ext)
    folder = F.when(F.col("doc_id") % 41 == 0, F.lit("node_modules")).otherwise(F.col("lang"))
    out = d.select(F.col("source").alias("root_id"), F.concat_ws("/", folder, name).alias("relative_path"), name.alias("name"), ext.alias("extension"), F.col("n_chars").alias("size"), (F.lit(EPOCH_MS) + F.col("doc_id") * 1000).alias("mtime_ms"), "text", "doc_id")
    return out.withColumn("absolute_path", F.concat(F.lit("/data/"), "root_id", F.lit("/"), "relative_path")).withColumn("fingerprint", F.concat_ws(":", "size", "mtime_ms"))


INVENTORY_SQL = f"""
    f0 as (select source as root_id, doc_id, n_chars as size, {EPOCH_MS} + doc_id * 1000 as mtime_ms, text,
                  case lang when 'en' then 'txt' when 'fr' then 'md' when 'de' then 'pdf' when 'es' then 'bin' end as extension,
                  case when doc_id % 41 = 0 then 'node_modules' else lang end as folder from documents),
    f1 as (select *, case when doc_id % 97 = 0 then '.env' else 'file_' end || doc_id || '.' || extension as name from f0),
    f as (select *, folder || '/' || name as relative_path, '/data/' || root_id || '/' || folder || '/' || name as absolute_path,
                 size || ':' || mtime_ms as fingerprint from f1)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path tree (path, size) from ``pages``: host and path of the address."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return p.select("page_id", path.alias("path"), F.length("html").cast("long").alias("size"))


PATHS_SQL = r"""
    p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path, length(html) as size from pages)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process samples from ``events``: pid by user, name by type, a sample a minute, one start a week."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.date_trunc("minute", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("at"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("pid"),
        F.concat("event_type", F.lit(".exe")).alias("name"),
        F.date_trunc("week", F.col("ts")).cast("timestamp_ntz").alias("started_at"),
        F.col("value").alias("memory"),
        F.col("event_id").cast("double").alias("cpu"),
        (F.col("event_id") % 13 != 0).alias("responding"),
    )


SAMPLES_SQL = """
    s as (select event_id, date_trunc('minute', ts) as at, ts, user_id as pid, event_type || '.exe' as name, date_trunc('week', ts)::timestamp as started_at,
                 value as memory, event_id::double as cpu, event_id % 13 <> 0 as responding from events)"""


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code chunks made from ``nation``: three files each, that define, import and call one another's functions."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "_")).alias("n"), F.col("n_regionkey").alias("r"))
    nl = F.lit("\n")
    define = F.concat(F.lit("export function load_"), "n", F.lit("(options) {"), nl, F.lit("    return fetchRegion"), "r", F.lit("('/api/region/"), "r", F.lit("/');"), nl, F.lit("}"))
    use = F.concat(F.lit("import { load_"), "n", F.lit(" } from './"), "n", F.lit("';"), nl, F.lit("const rows_"), "n", F.lit(" = load_"), "n", F.lit("({ limit: "), "k", F.lit(" });"))
    region = F.concat(F.lit("def fetchRegion"), "r", F.lit("(route):"), nl, F.lit("    # see /api/region/"), "r", nl, F.lit("    return openRegion(route, "), "k", F.lit(")"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), p.alias("file_path"), c.alias("content")) for i, (p, c) in enumerate([(F.concat(F.lit("src/"), "n", F.lit(".js")), define), (F.concat(F.lit("src/use_"), "n", F.lit(".ts")), use), (F.concat(F.lit("py/region_"), "r", F.lit(".py")), region)])]))
    return n.select("k", kinds.alias("x")).select((F.col("k") * 3 + F.col("x.i")).alias("chunk_id"), F.col("x.file_path"), (F.col("k") * 10 + 1).alias("start_line"), (F.col("k") * 10 + 3).alias("end_line"), F.col("x.content"), (1.0 / (F.col("k") + F.col("x.i") + 1)).alias("similarity"))


CODE_SQL = """
    n as (select n_nationkey as k, lower(regexp_replace(n_name, '[^A-Za-z]', '_', 'g')) as n, n_regionkey as r from nation),
    x as (select k, n, r, 0 as i, 'src/' || n || '.js' as file_path,
                 'export function load_' || n || '(options) {' || chr(10) || '    return fetchRegion' || r || '(''/api/region/' || r || '/'');' || chr(10) || '}' as content from n
          union all select k, n, r, 1, 'src/use_' || n || '.ts',
                 'import { load_' || n || ' } from ''./' || n || ''';' || chr(10) || 'const rows_' || n || ' = load_' || n || '({ limit: ' || k || ' });' from n
          union all select k, n, r, 2, 'py/region_' || r || '.py',
                 'def fetchRegion' || r || '(route):' || chr(10) || '    # see /api/region/' || r || chr(10) || '    return openRegion(route, ' || k || ')' from n),
    c as (select k * 3 + i as chunk_id, file_path, k * 10 + 1 as start_line, k * 10 + 3 as end_line, content, 1.0::double / (k + i + 1) as similarity from x)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan entries (DM-16) from ``lineitem``: a plan for each order, grants by supplier."""
    item = table(spark, sf_dir, "lineitem")
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "pdf", "xyz", "zip", "key"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return item.select(
        F.col("l_orderkey").alias("plan_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("entry_id"),
        F.col("l_suppkey").alias("grant_id"),
        F.concat(F.lit("/data/s"), "l_suppkey", F.lit("/p"), "l_partkey", F.lit("."), ext).alias("source_path"),
        F.concat(F.lit("/ext/P"), F.col("l_partkey") % 7, F.lit("."), ext).alias("destination_path"),
        (F.col("l_quantity") * 1_000_000).alias("size_bytes"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("mtime_ms"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("in_use"),
        F.when(F.col("l_linestatus") == "F", "verified").otherwise("copying").alias("state"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"),
    )


ENTRIES_SQL = """
    e as (select l_orderkey as plan_id, l_orderkey || ':' || l_linenumber as entry_id, l_suppkey as grant_id,
                 '/data/s' || l_suppkey || '/p' || l_partkey || '.' || ['mp4', 'pdf', 'xyz', 'zip', 'key'][(l_partkey % 5 + 1)::int] as source_path,
                 '/ext/P' || (l_partkey % 7) || '.' || ['mp4', 'pdf', 'xyz', 'zip', 'key'][(l_partkey % 5 + 1)::int] as destination_path,
                 l_quantity * 1000000 as size_bytes, epoch_ms(l_shipdate) as mtime_ms,
                 case l_returnflag when 'R' then true when 'A' then false end as in_use,
                 case when l_linestatus = 'F' then 'verified' else 'copying' end as state, l_linenumber as line, l_partkey as part,
                 l_shipdate::timestamp as shipped from lineitem)"""



#: Source texts of eight kinds; @k, @h, @q and @b are a part's number, its half, its fifth and its brand.
CODE_FORMS = [
    ("js", "export async function load_@k(options) {\n  // was fetchOld@k\n  return get_@h({ id: '@b' });\n}"),
    ("ts", "import { load_@h, save as saveItem@q } from './p@h';\nconst total@qSum = load_@h({ limit: 3 });\nexport { total@qSum as partTotal };"),
    ("py", "from shop.parts import get_@h, PartKind\n\nclass Part@kView(PartKind):\n    def draw_@k(self):\n        return get_@h('/api/parts/@q')"),
    ("ts", "export interface Row@k { a: load_@h; b: string }\nexport type Kind@q = Row@k"),
    ("md", "Use load_@h and Part@qView, see `POST /api/parts/@q/`"),
    ("js", "/* old: gone_@k() */\nconst get_@k = async (x) => {\n  const url = `/api/parts/@k`;\n  return await load_@q(x, { @b: \"it's fine\" });\n};"),
    ("py", "import helperTools\n# get_@h in a comment\ndef get_@k(part_no):\n    return load_@h(part_no) + draw_@q(1)"),
    ("js", "class Store@k extends Base_@q {\n  run() { return fetch('/api/parts/@h'); }\n}\nmodule.exports = { Store@k };"),
]


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code chunks made from ``part``, one a part, three parts a file: declarations, imports, calls, routes, comments and types that refer to other parts.

    Parts are dealt over all cores before texts are made of them, as a table of chunks would lie.
    """
    k = F.col("p_partkey")
    put = lambda c, token, value: F.replace(c, F.lit(token), value.cast("string"))
    filled = lambda form: put(put(put(put(F.lit(form), "@k", k), "@h", F.expr("p_partkey div 2")), "@q", F.expr("p_partkey div 5")), "@b", F.lower(F.translate("p_brand", "#", "_")))
    kind = lambda values: F.element_at(F.array(*values), (k % len(CODE_FORMS) + 1).cast("int"))
    path = F.concat(F.lit("src/M"), F.expr("p_partkey div 3"), F.lit("."), kind([F.lit(e) for e, _ in CODE_FORMS]))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").repartition(spark.sparkContext.defaultParallelism).select(
        k.alias("chunk_id"), path.alias("file_path"), (k * 10 + 1).cast("int").alias("start_line"), (k * 10 + 9).cast("int").alias("end_line"), kind([filled(f) for _, f in CODE_FORMS]).alias("content"), ((k * 7919) % 10007 / F.lit(10007.0)).alias("similarity")
    )


def _sql_text(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


CODE_CORPUS_SQL = f"""
    t as (select p_partkey as k, list_value({", ".join(f"'{e}'" for e, _ in CODE_FORMS)})[p_partkey % {len(CODE_FORMS)} + 1] as e,
        replace(replace(replace(replace(list_value({", ".join(_sql_text(f) for _, f in CODE_FORMS)})[p_partkey % {len(CODE_FORMS)} + 1], '@k', p_partkey::varchar), '@h', (p_partkey // 2)::varchar), '@q', (p_partkey // 5)::varchar), '@b', lower(replace(p_brand, '#', '_'))) as content,
        (p_partkey * 7919) % 10007 / 10007.0::double as similarity from part),
    c as (select k as chunk_id, 'src/M' || (k // 3) || '.' || e as file_path, k * 10 + 1 as start_line, k * 10 + 9 as end_line, content, similarity from t)"""
