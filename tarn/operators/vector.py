"""Vector retrieval (VEC-*): cosine, top-k, diversifying, near-ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR_TIE = 0.01


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """VEC-1: cosine in double precision; 0 where a vector has no length."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def valid(v: Column) -> Column:
    """VEC-10: not empty, all components finite."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def score(chunks: DataFrame, query: DataFrame, vector: str = "embedding", skip_other_lengths: bool = False) -> DataFrame:
    """VEC-2, JOIN-18: the chunks with ``similarity`` to the one query vector (a one-row frame).

    Vectors of another length are left out, or raise an error (SEM-7).
    """
    q = F.broadcast(query.select(F.col(vector).alias("__q"), norm(F.col(vector)).alias("__qn")).limit(1))
    joined = chunks.crossJoin(q)
    same = F.size(vector) == F.size("__q")
    if skip_other_lengths:
        joined = joined.where(same)
        value = cosine(F.col(vector), F.col("__q"), norm_b=F.col("__qn"))
    else:
        value = F.when(same, cosine(F.col(vector), F.col("__q"), norm_b=F.col("__qn"))).otherwise(F.raise_error("the vectors differ in length").cast("double"))
    return joined.withColumn("similarity", value).drop("__q", "__qn")


def top_k(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """VEC-3, ORD-1."""
    return scored.orderBy(F.desc("similarity"), *ties).limit(k)


def diversify(scored: DataFrame, k: int, file: str, *ties: str, per_file: int = 2) -> DataFrame:
    """VEC-6, CF-1: at most ``per_file`` of a file first, the others after them, the best k; adds ``rank``.

    What can be among the best k is at most k of each file, so a window of groups cut at k
    rows comes first and the global rank is over the sorted rest only.
    """
    order = [F.desc("similarity"), *ties]
    rn = F.row_number().over(Window.partitionBy(file).orderBy(*order))
    ranked = scored.withColumn("__rn", rn).where(F.col("__rn") <= k)
    best = ranked.orderBy(F.col("__rn") > per_file, *order).limit(k)
    place = F.row_number().over(Window.orderBy(F.col("__rn") > per_file, *order))
    return best.withColumn("rank", place).drop("__rn")


def near_tie(scored: DataFrame, k: int, preferred: str, *ties: str, eps: float = NEAR_TIE) -> DataFrame:
    """VEC-5, SEQ-1: the best k when, within buckets of near-equal similarity, preferred rows come first; adds ``bucket`` and ``rank``.

    A bucket opens at the first row more than eps below its leader, so the leaders of all
    buckets that the best k rows touch are among these k similarities.  However many
    rows share the last bucket, they are only sorted for the best k.
    """
    order = [F.desc("similarity"), *ties]
    head = scored.orderBy(*order).limit(k).agg(F.collect_list("similarity").alias("s")).select(F.sort_array("s", asc=False).alias("s"))
    none = F.array().cast("array<double>")
    leaders = F.aggregate("s", none, lambda found, x: F.when((F.size(found) == 0) | (F.element_at(found, -1) - x > eps), F.concat(found, F.array(x))).otherwise(found))
    few = head.select(F.posexplode(leaders).alias("bucket", "__lead"))
    # A row lies in the one bucket whose leader is not below it and at most eps above it; there are at most k leaders.
    pool = scored.join(F.broadcast(few), (F.col("similarity") <= F.col("__lead")) & (F.col("__lead") - F.col("similarity") <= eps)).drop("__lead")
    best = [F.col("bucket"), F.desc(preferred), *order]
    return pool.orderBy(*best).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*best)))


#: Query rows that meet a share of the base at once, and base rows of a share, about.
KNN_QUERIES = 1 << 12
KNN_SHARE = 1 << 15
#: Query rows that are multiplied at once, and what rounding can differ between two orders of a sum.
KNN_BLOCK = 256
ROUNDING = 1e-9


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, NaN where they are shorter than the longest, and the lengths; -1 where a vector or a component is null."""
    vectors = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors)
    nulls = np.zeros(len(values), bool) if values.null_count == 0 else values.is_null().to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.nan)
    filled = np.arange(out.shape[1]) < sizes[:, None]
    out[filled] = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    holes = np.zeros(out.shape, bool)
    holes[filled] = nulls
    sizes[holes.any(axis=1)] = -1
    return out, sizes


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last, as ``dot`` sums them."""
    total = np.zeros(max(len(a), len(b)))
    for d in range(a.shape[-1]):
        total = total + a[:, d] * b[:, d]
    return total


def _nearest(k: int):
    """For a cogroup of queries (query, vector) and base rows (key, vector): the k nearest of each, null and NaN as Spark ranks them."""

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        out = {"query": [], "key": [], "similarity": []}
        q_keys, b_keys = queries.column("query").combine_chunks(), base.column("key").combine_chunks()
        (q, q_sizes), (b, b_sizes) = _matrix(queries.column("vector")), _matrix(base.column("vector"))
        # Ranks of the keys, so that keys of any kind are told apart and ordered.
        codes = pc.rank(pa.concat_arrays([q_keys, b_keys]), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        q_code, b_code = codes[: len(q_keys)], codes[len(q_keys) :]
        for size in np.unique(q_sizes).tolist():
            asked = np.flatnonzero(q_sizes == size)
            same = (b_sizes == size) if size >= 0 else np.zeros(len(b_sizes), bool)
            rows, width = np.flatnonzero(same), max(size, 0)
            mine = np.ascontiguousarray(b[rows, :width])
            with np.errstate(all="ignore"):
                norms = np.sqrt(_in_order(mine, mine))
                unit = np.where(norms[:, None] == 0, 0.0, mine / norms[:, None])
                for at in range(0, len(asked), KNN_BLOCK):
                    block = asked[at : at + KNN_BLOCK]
                    vectors = q[block, :width]
                    q_norms = np.sqrt(_in_order(vectors, vectors))
                    near = np.where(q_norms[:, None] == 0, 0.0, vectors / q_norms[:, None]) @ unit.T
                    near[~np.isfinite(near)] = np.inf  # told apart below
                    near[q_code[block][:, None] == b_code[rows][None, :]] = -np.inf
                    for i, n in enumerate(block.tolist()):
                        few = np.arange(len(rows))
                        if len(rows) > k:
                            few = np.flatnonzero(near[i] >= np.partition(near[i], -k)[-k] - ROUNDING)
                        few = few[b_code[rows[few]] != q_code[n]]
                        exact = _in_order(vectors[i : i + 1], mine[few]) / (norms[few] * q_norms[i])
                        exact[(norms[few] == 0) | (q_norms[i] == 0)] = 0.0
                        picked, found = rows[few], exact
                        if len(few) < k:  # rows whose similarity is null come last
                            rest = np.flatnonzero(~same & (b_code != q_code[n]))
                            rest = rest[np.argsort(b_code[rest], kind="stable")[: k - len(few)]]
                            picked, found = np.append(rows[few], rest), np.append(exact, np.full(len(rest), -np.inf))
                        best = np.lexsort((b_code[picked], -found, ~np.isnan(found)))[:k]
                        out["query"].append(np.full(len(best), n))
                        out["key"].append(picked[best])
                        out["similarity"].append(found[best])
        at_q, at_b, value = (np.concatenate(out[c]) if out[c] else np.zeros(0) for c in out)
        return pa.table([q_keys.take(pa.array(at_q.astype(np.int64))), b_keys.take(pa.array(at_b.astype(np.int64))), pa.array(value.astype(float), mask=np.isneginf(value))], names=["query", "key", "similarity"])

    return run


def knn(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """(query, key, similarity, rank): the k nearest rows of each query row, itself left out.

    Query rows are cut into blocks and base rows dealt into shares; each block meets each
    share, all blocks at once.  A matrix product tells which rows can be among a share's k
    nearest; their similarities are then summed in the order of the components, so that equal
    vectors tie.  The work is queries times base rows, which an exact search can't avoid; what
    a task holds is one block and one share.
    """
    n, m = queries.count(), base.count()
    blocks, shares = max(1, -(-n // KNN_QUERIES)), max(1, -(-m // KNN_SHARE), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = min(shares, max(1, m // 1024))
    number = lambda c, most: F.pmod(F.xxhash64(c), F.lit(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("vector")).withColumn("block", number("query", blocks)).withColumn("share", every(shares))
    b = base.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector")).withColumn("share", number("key", shares)).withColumn("block", every(blocks))
    kind = base.schema[key].dataType.simpleString()
    met = q.groupBy("block", "share").cogroup(b.groupBy("block", "share")).applyInArrow(_nearest(k), f"query {kind}, key {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.col("key").alias(key), "similarity", "rank")
