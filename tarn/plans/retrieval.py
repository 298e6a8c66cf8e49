"""Vector, text and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as t
from tarn.operators import chunking, storage, vector
from tarn.plans.registry import query
from tarn.sources.tables import table

COS = "coalesce(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0)"
SCORED = f"q as (select embedding from embeddings where vec_id = 0), s as (select e.vec_id, e.label, {COS} as similarity from embeddings e, q)"


def _six(c: str = "similarity") -> F.Column:
    return F.round(c, 6).alias(c)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.score(e, e.where("vec_id = 0")).select("vec_id", "label", "similarity")


@query(f"with {SCORED} select vec_id, round(similarity, 6) as similarity from s order by s.similarity desc, vec_id limit 5")
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-3."""
    return vector.top_k(_scored(spark, sf_dir), 5, "vec_id").select("vec_id", _six())


@query(f"""
    with b as (select q.vec_id as query, e.vec_id, {COS} as similarity from embeddings e join embeddings q on q.vec_id % 100 = 0 and e.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query order by similarity desc, vec_id) as rank from b)
    select query, vec_id, round(similarity, 6) as similarity, rank from r where rank <= 5""")
def vec_batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.knn(e.where("vec_id % 100 = 0"), e, 5, "vec_id").select("query", "vec_id", _six(), F.col("rank").cast("long").alias("rank"))


@query("""
    select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity
    from embeddings a join embeddings b on a.vec_id < b.vec_id where a.vec_id < 10 and b.vec_id < 10""")
def vec_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-4: a fixture of ten vectors, each pair once; nearest neighbours over all rows are vec_batch_knn."""
    e = table(spark, sf_dir, "embeddings").where("vec_id < 10").select("vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("a.vec_id") < F.col("b.vec_id")).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(vector.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity"))


@query(f"""
    with {SCORED}, r as (select *, row_number() over (partition by label order by similarity desc, vec_id) as rn from s),
    k as (select *, row_number() over (order by rn > 2, similarity desc, vec_id) as rank from r)
    select vec_id, label, round(similarity, 6) as similarity, rank from k where rank <= 8""")
def vec_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-6: two of each label (as file) first."""
    return vector.diversify(_scored(spark, sf_dir), 8, "label", "vec_id").select("vec_id", "label", _six(), F.col("rank").cast("long").alias("rank"))


@query(f"with {SCORED} select vec_id, label, round(similarity, 6) as similarity from s where label in (1, 3) order by s.similarity desc, vec_id limit 6")
def vec_prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: the filter comes before scoring and reaches the scan."""
    e = table(spark, sf_dir, "embeddings")
    return vector.top_k(vector.score(e.where(F.col("label").isin(1, 3)), e.where("vec_id = 0")), 6, "vec_id").select("vec_id", "label", _six())


NEAR = f"""
    with recursive {SCORED}, r as (select *, row_number() over (order by similarity desc, vec_id) as rn from s),
    p as (select * from r where similarity >= (select min(similarity) - 0.01 from r where rn <= 8)),
    w as (select rn, similarity as lead, 0 as bucket from p where rn = 1
          union all select p.rn, case when w.lead - p.similarity > 0.01 then p.similarity else w.lead end,
                 w.bucket + case when w.lead - p.similarity > 0.01 then 1 else 0 end from w join p on p.rn = w.rn + 1),
    t as (select p.*, w.bucket, row_number() over (order by w.bucket, (p.label % 2 = 0) desc, p.rn) as rank from p join w using (rn))"""


@query(NEAR + " select vec_id, label, round(similarity, 6) as similarity, bucket, rank from t where rank <= 8")
def vec_near_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-5: even labels stand for implementation files."""
    tied = vector.near_tie(_scored(spark, sf_dir).withColumn("preferred", F.col("label") % 2 == 0), 8, "preferred", "vec_id")
    return tied.select("vec_id", "label", _six(), "bucket", F.col("rank").cast("long").alias("rank"))


@query(NEAR + """, u as (select *, row_number() over (partition by label order by rank) as rn2 from t where rank <= 24),
    k as (select *, row_number() over (order by rn2 > 2, rank) as place from u where rank <= 8)
    select vec_id, label, round(similarity, 6) as similarity, place from k""")
def vec_ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-7: score, near-ties, diversify."""
    from pyspark.sql import Window

    tied = vector.near_tie(_scored(spark, sf_dir).withColumn("preferred", F.col("label") % 2 == 0), 8, "preferred", "vec_id")
    capped = tied.withColumn("rn2", F.row_number().over(Window.partitionBy("label").orderBy("rank")))
    return capped.select("vec_id", "label", _six(), F.row_number().over(Window.orderBy(F.col("rn2") > 2, "rank")).cast("long").alias("place"))


@query("select label, count(*) as vectors, count(*) filter (len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0) as valid from embeddings group by label")
def vec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-10."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(vector.valid(F.col("embedding"))).alias("valid"))


@query(f"with {SCORED.replace('from embeddings e, q)', 'from embeddings e, q where e.vec_id % 7 <> 0)')} select label, count(*) as scored, round(max(similarity), 6) as best from s group by label")
def vec_dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEM-7: rows of another length are skipped; every seventh vector is cut short here."""
    e = table(spark, sf_dir, "embeddings")
    mixed = e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    scored = vector.score(mixed, e.where("vec_id = 0"), skip_other_lengths=True)
    return scored.groupBy("label").agg(F.count("*").alias("scored"), F.round(F.max("similarity"), 6).alias("best"))


def cut_sql(source: str, target: int, overlap: int, next_from_trimmed: bool) -> str:
    """Recursive SQL for the chunkers with boundaries that depend on the text before: cuts(id, idx, a, b, t) from ``source`` (id, t)."""
    last = lambda x, mark: f"case when strpos(reverse({x}), {mark}) = 0 then -1 else length({x}) - strpos(reverse({x}), {mark}) - length({mark}) + 1 end"
    two, one, blank = "chr(10) || chr(10)", "chr(10)", "' '"
    follow = "a + length(piece)" if next_from_trimmed else "e2"
    return rf"""
    cuts(id, t, n, nxt, idx, a, b) as (select id, t, length(t), 0::bigint, -1, 0::bigint, 0::bigint from ({source})
      union all select id, t, n, case when {follow} >= n then n else greatest({follow} - {overlap}, a + 1) end, idx + 1, a, a + length(piece) from (
        select *, regexp_replace(substr(t, a + 1, e2 - a), '\s+$', '') as piece from (
          select *, case when e1 < n and not regexp_matches(substr(t, e1 + 1, 1), '\s') and not regexp_matches(right(p, 1), '\s') and {last("p", blank)} > 0 then a + {last("p", blank)} else e1 end as e2 from (
            select *, substr(t, a + 1, e1 - a) as p from (
              select *, case when e0 < n and {last("w", f"({two})")} >= {target} * 0.4 then a + {last("w", f"({two})")} when e0 < n and {last("w", one)} >= {target} * 0.5 then a + {last("w", one)}
                             when e0 < n and {last("w", blank)} >= {target} * 0.5 then a + {last("w", blank)} else e0 end as e1 from (
                select *, substr(t, a + 1, e0 - a) as w from (
                  select *, least(a + {target}, n) as e0 from (select id, t, n, idx, nxt + length(regexp_extract(substr(t, nxt + 1), '^\s*')) as a from cuts where nxt < n) where a < n)))))))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""select doc_id, sha256(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g')) as digest from documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-2."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.normalize(F.col("text")), 256).alias("digest"))


PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"select doc_id, case when length({PLAIN}) > 280 then left({PLAIN}, 279) || '…' else {PLAIN} end as preview, case when length({PLAIN}) > 140 then rtrim(left({PLAIN}, 139)) || '…' else {PLAIN} end as memory_preview from documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-3, STR-4."""
    return _docs(spark, sf_dir).select("doc_id", t.preview(F.col("text")).alias("preview"), t.preview(F.col("text"), 140, trim=True).alias("memory_preview"))


SCRUB = PLAIN
for _p, _m in ((r"[A-Za-z]:\\[^\s]{6,}", "[path]"), (r"(?i)/(?:Users|home|var|etc|Windows)[^\s]{3,}", "[path]"), (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[email]"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[ip]")):
    SCRUB = f"regexp_replace({SCRUB}, '{_p}', '{_m}', 'g')"


@query(f"select doc_id, case when length(x) > 180 then left(x, 179) || '…' else x end as scrubbed, contains(x, '[email]') as had_mail from (select doc_id, {SCRUB} as x from documents)")
def text_scrub_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6."""
    whole = _docs(spark, sf_dir).select("doc_id", t.scrub(F.col("text"), None).alias("whole"))  # scrubbed once, used twice
    return whole.select("doc_id", t.clamp(F.col("whole"), 180).alias("scrubbed"), F.contains("whole", F.lit("[email]")).alias("had_mail"))


@query(r"""with m as (select doc_id, 'cannot read /home/u' || doc_id || '/notes/a.txt: ' || text || chr(10) || 'stack' as message from documents),
    n as (select doc_id, trim(regexp_replace(regexp_replace(split_part(message, chr(10), 1), '[A-Za-z]:\\[^\s]+', '[path]', 'g'), '(?:/[A-Za-z0-9._-]+){2,}', '[path]', 'g')) as x from m)
    select doc_id, case when length(x) > 280 then left(x, 279) || '…' else x end as message from n""")
def text_issue_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7."""
    message = F.concat(F.lit("cannot read /home/u"), "doc_id", F.lit("/notes/a.txt: "), "text", F.lit("\nstack"))
    return _docs(spark, sf_dir).select("doc_id", t.issue_message(message).alias("message"))


@query("""select doc_id, left(sha256(source), 16) as root_id, left(sha256(source || '|' || doc_id || '|' || n_chars || '|0'), 24) as chunk_id,
    'idxf_' || left(sha256(source || '|' || doc_id), 32) as file_ref from documents""")
def text_ids_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HASH-1."""
    c = [F.col(x).cast("string") for x in ("source", "doc_id", "n_chars")]
    return _docs(spark, sf_dir).select("doc_id", t.digest(c[0], size=16).alias("root_id"), t.digest(*c, F.lit("0"), size=24).alias("chunk_id"), t.digest(*c[:2], size=32, prefix="idxf_").alias("file_ref"))


NAMES_SQL = "n as (select doc_id, ['notes.TXT', 'a.b.Pdf', '.env', 'x.docx', 'README', 'run.tar.gz', 'main.py'][(doc_id % 7 + 1)::int] as name from documents)"


@query(f"""with {NAMES_SQL}, x as (select *, lower(regexp_extract(name, '[^/]\\.([^./]*)$', 1)) as ext from n)
    select doc_id, ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') as stem,
           case when ext in ('txt', 'py') then 'text' when ext in ('pdf', 'docx') then ext end as kind from x""")
def text_ext_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-9, FLT-5."""
    names = F.array(*map(F.lit, ("notes.TXT", "a.b.Pdf", ".env", "x.docx", "README", "run.tar.gz", "main.py")))
    n = _docs(spark, sf_dir).select("doc_id", F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("name"))
    ext = t.extension(F.col("name"))
    return n.select("doc_id", ext.alias("ext"), t.stem(F.col("name")).alias("stem"), storage.content_kind(ext).alias("kind"))


@query("""with x as (select doc_id, case when doc_id % 3 = 0 then '<think>' || left(text, 40) || '</think> ' || text when doc_id % 3 = 1 then 'a</think>b</think>' || text else text end as s from documents)
    select doc_id, sha256(trim(list_last(string_split(s, '</think>')), ' ' || chr(10) || chr(9))) as digest from x""")
def text_think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8."""
    s = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), F.left("text", F.lit(40)), F.lit("</think> "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a</think>b</think>"), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(t.after_thinking(s), 256).alias("digest"))


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*', 0)) as w from documents)
    select doc_id, count(*) as identifiers, count(distinct w) as distinct_identifiers, count(*) filter (regexp_matches(w, '[a-z][A-Z]') or regexp_matches(w, '[A-Z][a-z]+[A-Z]') or contains(w, '$') or (contains(w, '_') and regexp_matches(w, '[A-Za-z]'))) as shaped
    from w group by doc_id""")
def text_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16, STR-17: arrays within the row, so nothing is shuffled."""
    ids = t.identifiers(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", ids.alias("i")).where(F.size("i") > 0).select(
        "doc_id", F.size("i").cast("long").alias("identifiers"), F.size(F.array_distinct("i")).cast("long").alias("distinct_identifiers"), F.size(F.filter("i", t.code_shaped)).cast("long").alias("shaped")
    )


@query(r"""with x as (select doc_id, 'fetch("/api/' || source || '/' || (doc_id % 5) || '/"); log(''GET /api/logs/' || (doc_id % 3) || '''); q = `/api/' || source || '/' || (doc_id % 5) || '`' as s from documents),
    r as (select doc_id, list_distinct(list_transform(list_concat(regexp_extract_all(s, '"(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)"', 1), regexp_extract_all(s, '`(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)`', 1), regexp_extract_all(s, '(?i)[''"`](?:GET|POST|PUT|PATCH|DELETE)\s+(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)', 1)), lambda r: regexp_replace(r, '/+$', ''))) as r from x)
    select doc_id, list_aggregate(list_sort(r), 'string_agg', ',') as routes from r""")
def text_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18."""
    n = F.col("doc_id") % 5
    s = F.concat(F.lit('fetch("/api/'), "source", F.lit("/"), n, F.lit("/\"); log('GET /api/logs/"), F.col("doc_id") % 3, F.lit("'); q = `/api/"), "source", F.lit("/"), n, F.lit("`"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(t.api_routes(s)), ",").alias("routes"))


def _lines(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""with l as (select doc_id, string_split_regex(text, '\\r?\\n') as x from documents),
    c as (select doc_id, x, unnest(range(0, greatest(1, ceil((len(x) - {overlap}) / {step}::double))::bigint)) * {step} as s from l),
    t as (select doc_id, s + 1 as start_line, least(s + {size}, len(x)) as end_line, trim(array_to_string(x[s + 1 : s + {size}], chr(10)), ' ' || chr(9) || chr(10)) as content from c)
    select doc_id, start_line, end_line, sha256(content) as digest from t where content <> ''"""


def _line_query(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    found = chunking.line_chunks(_docs(spark, sf_dir).select("doc_id", "text"), "text", size, overlap)
    return found.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("content", 256).alias("digest"))


@query(_lines(50, 8))
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1."""
    return _line_query(spark, sf_dir, 50, 8)


@query(_lines(6, 2))
def chunk_lines_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-1 with short chunks, as few documents have 50 lines."""
    return _line_query(spark, sf_dir, 6, 2)


@query("with recursive " + cut_sql("select doc_id as id, coalesce(text, '') as t from documents", 1500, 200, False) + """
    select id as doc_id, idx as chunk_index, a::int as start_char, b::int as end_char, sha256(substr(t, a + 1, b - a)) as digest from cuts where idx >= 0""")
def chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-2; boundaries depend on the text before, so the SQL is recursive."""
    return chunking.char_chunks(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("content", 256).alias("digest"))


PAGES = "pg as (select doc_id, unnest(range(0, greatest(1, ceil(n_chars / 900.0))::bigint)) as page, n_chars from documents)"


@query(f"""with c as (select doc_id, unnest(range(0, greatest(1, ceil(n_chars / 1300.0))::bigint)) as i, n_chars from documents), {PAGES}
    select c.doc_id, c.i as chunk_index, min(pg.page) + 1 as page_start, max(pg.page) + 1 as page_end
    from c left join pg on pg.doc_id = c.doc_id and c.i * 1300 < least((pg.page + 1) * 900, pg.n_chars) and pg.page * 900 < least(c.i * 1300 + 1500, c.n_chars) group by 1, 2""")
def chunk_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-4: chunks of 1500 every 1300 characters, pages of 900."""
    d = _docs(spark, sf_dir).select("doc_id", "n_chars")
    count = lambda step: F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("n_chars") / step)) - 1).cast("int"))
    chunks = d.select("doc_id", "n_chars", F.explode(count(1300)).alias("chunk_index")).select("doc_id", "chunk_index", (F.col("chunk_index") * 1300).alias("start_char"), F.least(F.col("chunk_index") * 1300 + 1500, "n_chars").alias("end_char"))
    pages = d.select("doc_id", "n_chars", F.explode(count(900)).alias("p")).select("doc_id", (F.col("p") + 1).alias("page"), (F.col("p") * 900).alias("span_start"), F.least((F.col("p") + 1) * 900, "n_chars").alias("span_end"))
    found = chunking.page_ranges(chunks, pages, ["doc_id"], ["chunk_index"])
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "page_start", "page_end")])


@query(f"""with c as (select doc_id, unnest(range(0, greatest(1, ceil(n_chars / 1300.0))::bigint)) as i, n_chars from documents), {PAGES}
    select c.doc_id, c.i as chunk_index, pg.page as message, greatest(c.i * 1300, pg.page * 900) - pg.page * 900 as segment_start, least(c.i * 1300 + 1500, c.n_chars, (pg.page + 1) * 900) - pg.page * 900 as segment_end
    from c join pg on pg.doc_id = c.doc_id and c.i * 1300 < least((pg.page + 1) * 900, pg.n_chars) and pg.page * 900 < least(c.i * 1300 + 1500, c.n_chars)""")
def chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-5: messages of 900 characters in a row."""
    d = _docs(spark, sf_dir).select("doc_id", "n_chars")
    count = lambda step: F.sequence(F.lit(0), (F.greatest(F.lit(1), F.ceil(F.col("n_chars") / step)) - 1).cast("int"))
    chunks = d.select("doc_id", "n_chars", F.explode(count(1300)).alias("chunk_index")).select("doc_id", "chunk_index", (F.col("chunk_index") * 1300).alias("start_char"), F.least(F.col("chunk_index") * 1300 + 1500, "n_chars").alias("end_char"))
    parts = d.select("doc_id", "n_chars", F.explode(count(900)).alias("message")).select("doc_id", "message", (F.col("message") * 900).alias("span_start"), F.least((F.col("message") + 1) * 900, "n_chars").alias("span_end"))
    found = chunking.message_segments(chunks, parts, ["doc_id"])
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "message", "segment_start", "segment_end")])


@query("""with s as (select doc_id, ['I''ll now fetch that file.', 'Done. The file was read.', 'First, let me quickly check the index: it is small.', 'Let me think.', 'I will review it. Then more. And more.', 'OK. I’m going to list the folder'][(doc_id % 6 + 1)::int] as x from documents)
    select doc_id, doc_id % 6 in (0, 2, 5) as promises from s""")
def dia_commitment_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20."""
    said = ["I'll now fetch that file.", "Done. The file was read.", "First, let me quickly check the index: it is small.", "Let me think.", "I will review it. Then more. And more.", "OK. I’m going to list the folder"]
    return _docs(spark, sf_dir).select("doc_id", t.promises_action(F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 6 + 1).cast("int"))).alias("promises"))


