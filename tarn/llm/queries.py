"""The registered queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, conversation_repair, embedding_dedup, exact_dedup, hard_negatives, line_dedup, packing, ppm, secrets, simhash, suffix_dedup, token_counts, toxicity
from tarn.llm.common import table


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def toxicity_folds() -> tuple[F.Column, F.Column, F.Column]:
    """Predicates on ``key``: rows whose labels the models count, rows the logistic function is fitted to, rows held out."""
    fold = F.crc32(F.col("key").cast("string")) % 4
    return fold.isin(0, 1), fold == 3, fold == 2


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "fingerprint", "component_id", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), byte_bpe())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", "text_sha256")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform(F.filter("spans", lambda s: F.size(s["linked"]) > 0), lambda s: F.concat_ws(">", F.concat_ws(":", s["kind"], s["start"], s["end"]), joined(s["linked"]))), ";").alias("links"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, fitted, held_out = toxicity_folds()
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), counted, fitted)
    return found.select(F.col("key").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), byte_bpe())


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("key").cast("string")) % 7
    found = ppm.score(table(spark, sf_dir, "documents"), fold != 2)
    return found.select(F.col("key").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("key") % 50 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, turns = conversation_repair.repair(conversation_repair.damage(rows))
    found = report.join(conversation_repair.digests(turns).withColumnRenamed("conv", "other"), F.col("conv").eqNullSafe(F.col("other"))).drop("other")
    joined = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OPERATORS = (
    op1_simhash_near_dedup,
    op2_packing,
    op3_line_dedup,
    op4_token_counts,
    op5_exact_dedup,
    op6_secret_scans,
    op7_suffix_array_dedup,
    op8_embedding_near_dedup,
    op9_toxicity,
    op10_bpe,
    op11_ppm,
    op12_hard_negatives,
    op13_conversation_repair,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {
    # A line goes if and only if it lies in one of the shortest runs of at least eight words that an earlier document holds.
    "op3_line_dedup": r"""
        with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
        t as (select *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from raw),
        l as (select doc_id, pos, t, len(string_split_regex(t, '[\x20\x09-\x0D]+')) as w, row_number() over (partition by doc_id order by pos) as p from t where t <> ''),
        c as (select *, sum(w) over (partition by doc_id order by p) as till from l),
        b as (
            select a.doc_id, a.p as i, min(z.p) as j from c a join c z on z.doc_id = a.doc_id and z.p between a.p and a.p + 7 and z.till - a.till + a.w >= 8 group by all
            union
            select z.doc_id, max(a.p) as i, z.p as j from c a join c z on z.doc_id = a.doc_id and a.p between z.p - 7 and z.p and z.till - a.till + a.w >= 8 group by z.doc_id, z.p),
        s as (select b.doc_id, i, j, string_agg(t, chr(10) order by p) as block from b join c on c.doc_id = b.doc_id and c.p between i and j group by b.doc_id, i, j),
        f as (select *, min(doc_id) over (partition by block) as first from s),
        g as (select distinct c.doc_id, c.pos from f join c on c.doc_id = f.doc_id and c.p between i and j where first < f.doc_id),
        k as (select t.doc_id, string_agg(line, chr(10) order by t.pos) as kept from t left join g on g.doc_id = t.doc_id and g.pos = t.pos where g.pos is null group by t.doc_id)
        select d.doc_id, (select count(*) from l where l.doc_id = d.doc_id) as n_lines, (select count(*) from g where g.doc_id = d.doc_id) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
        from documents d left join k on k.doc_id = d.doc_id""",
    "op5_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    # Every window of 400 bytes by its hash; windows that occur again are merged into runs.
    "op7_suffix_array_dedup": """
        with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select doc_id, i, hash(array_slice(b, i + 1, i + 400)) as h from (select doc_id, b, unnest(range(0, n - 399)) as i from d where n >= 400)),
        r as (select doc_id, i from w qualify count(*) over (partition by h) > 1),
        g as (select doc_id, i, sum(case when prev is null or i > prev + 400 then 1 else 0 end) over (partition by doc_id order by i) as k from (select *, lag(i) over (partition by doc_id order by i) as prev from r)),
        s as (select doc_id, k, min(i) as a, max(i) + 400 as z from g group by all),
        p as (select *, coalesce(lag(z) over (partition by doc_id order by a), 0) as f from s),
        q as (select p.doc_id, count(*) as runs, sum(z - a) as gone, string_agg(hex(array_slice(b, f + 1, a)), '' order by a) || hex(array_slice(any_value(b), max(z) + 1, any_value(n))) as kept from p join d on d.doc_id = p.doc_id group by p.doc_id)
        select d.doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(runs, 0) as n_spans, case when runs is null then sha256(b) else sha256(unhex(kept)) end as kept_sha256 from d left join q on q.doc_id = d.doc_id""",
    # All links by brute force; the index is at work at every size, and a test measures its recall where there are many links.
    "op8_embedding_near_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (select vec_id as n, vec_id as c from embeddings union select l.b, r.c from r join l on r.n = l.a),
        m as (select n, min(c) as component_id from r group by n), k as (select a, count(*) as n_links from l group by a)
        select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from embeddings left join m on n = vec_id left join k on a = vec_id""",
    # All scores by brute force.
    "op12_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 50 = 0 and len(a.e) = len(b.e) and a.vec_id <> b.vec_id),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3""",
    # The cheapest (cost, audit) of each state, turn by turn; the roles of edited turns follow from their place.
    "op13_conversation_repair": r"""
        with recursive b as (select *, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as name from conversations),
        h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                     xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(name) + 1), lambda i: [ord(substr(name, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
                         lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) % 20 as f from b),
        d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when f = 3 then [0, 1] else [0] end) as again from h where f <> 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), again) as n from d),
        k as (select conv_id, n, turn, role, text, role[1] as r, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by n) > 1 as seen,
                     not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(role[1]) over (partition by conv_id order by n) as prev from o),
        l as (select *, case when cut then 3 else 0 end as x, blank or seen as gone from k),
        g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(seen and not blank) as duplicate, count_if(cut and not blank and not seen) as truncated,
                     count_if(prev is not null and prev || r not in ('su', 'ua', 'au')) as illegal, max(n) as m from l group by conv_id),
        w as (select conv_id, 0::bigint as n, {'c': 0::bigint, 'a': ''} as s0, {'c': 1000000000::bigint, 'a': ''} as s1, {'c': 1000000000::bigint, 'a': ''} as s2, {'c': 1000000000::bigint, 'a': ''} as s3 from g
            union all
            select conv_id, n, {'c': s0.c + 4, 'a': s0.a || 'D'},
                list_min([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': s0.c + case when r = 's' then 0 else 1000000000 end + y, 'a': s0.a || 'K'}]),
                list_min([{'c': i2.c + 4, 'a': i2.a || 'D'}, {'c': s0.c + u + y, 'a': s0.a || eu}, {'c': s1.c + u + y, 'a': s1.a || eu}, {'c': i3.c + u + y, 'a': i3.a || eu}]),
                list_min([{'c': i3.c + 4, 'a': i3.a || 'D'}, {'c': i2.c + v + y, 'a': i2.a || ev}])
            from (select *, list_min([s3, {'c': i2.c + 3, 'a': i2.a || 'I'}]) as i3 from (
                select w.conv_id, l.n, r, s0, s1, s3, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}]) as i2,
                       x + case when gone then 1000000000 else 0 end as y, case when r = 'u' then 0 else 3 end as u, case when r = 'u' then 'K' else 'R' end as eu, case when r = 'a' then 0 else 3 end as v, case when r = 'a' then 'K' else 'R' end as ev
                from w join l on l.conv_id is not distinct from w.conv_id and l.n = w.n + 1))),
        a as (select conv_id, list_min([s0, s3, {'c': i2.c + 3, 'a': i2.a || 'I'}]) as best from (
            select w.conv_id, s0, s3, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}]) as i2 from w join g on g.conv_id is not distinct from w.conv_id and g.m = w.n)),
        e as (select conv_id, p, best.a[p] as edit, count_if(best.a[p] <> 'I') over z as at, count_if(best.a[p] <> 'D') over z as made from (select *, unnest(range(1, len(best.a) + 1)) as p from a) window z as (partition by conv_id order by p)),
        j as (select e.*, l.role, l.text, max(case when made = 1 and edit = 'K' and r = 's' then 1 else 0 end) over (partition by e.conv_id) as s from e left join l on l.conv_id is not distinct from e.conv_id and l.n = e.at and edit <> 'I' where edit <> 'D'),
        q as (select conv_id, string_agg(case when edit = 'K' then role when (made - s) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) as kept from j group by conv_id)
        select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(kept, '')) as repaired_sha256
        from (select distinct conv_id from conversations) c left join g on g.conv_id is not distinct from c.conv_id left join a on a.conv_id is not distinct from c.conv_id left join q on q.conv_id is not distinct from c.conv_id""",
}
