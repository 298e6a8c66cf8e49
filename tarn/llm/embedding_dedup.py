"""Operator 8: embedding near-dedup over an inverted multi-index.

Unit vectors are cut into halves with a codebook each; the product of the two codebooks is a
grid of cells, some ``CELL`` vectors in each however many there are.  Every vector is filed
under its cell and probes the cells nearest to it, in the order of a multi-sequence traversal
of the two sorted lists of centroids.  How many cells it visits is measured: the rank of its
cell from a vector at just the linking cosine, at the quantile of the target recall, with no
upper limit.  Of a pair the item with the smaller number probes, so a pair is met once and
its link counted once.  Found pairs are verified in double precision.

Codebooks are fitted on at most ``sample`` vectors (of the smallest hashes), with no more
centroids than one in ``FIT`` of them; every vector is indexed.  Equal vectors of a label are
one item with a multiplicity.  The lists of visited cells, without the vectors, are counted
first; a vector then goes once to each block of a cell that it is compared in.  A block
returns sums of links per item and a spanning forest, so a crowded cell is never gathered and
pairs are not listed.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label
or key, link with nothing.  A vector links only with vectors of its length; those of a rarer
length share one cell, so do vectors of one component or fewer than four in all.  Very long
vectors are cut into two halves like any others.  Rows that repeat a key are rows of their
own; labels of other types than integers are compared by a 64-bit hash; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import components, cut, forest, join_counted, map_groups

COSINE = 0.93
RECALL = 0.99
SAMPLE = 32_768
#: Vectors in a cell on average, and vectors of the sample for a centroid at least.
CELL = 256
FIT = 16
CHUNK = 2048
SEED = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.concatenate([distances(x[k : k + 4096], centers).argmin(axis=1) for k in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)[None, :], 0)


def reachable(rows: int, columns: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a sorted grid with (i + 1)(j + 1) <= visits."""
    each = np.minimum(visits // np.arange(1, min(rows, visits) + 1), columns)
    i = np.repeat(np.arange(len(each)), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)


def traverse(one: np.ndarray, two: np.ndarray, visits: int) -> np.ndarray:
    """For each row the ``visits`` cells with the smallest sums one[i] + two[j], nearest first.

    Of two sorted lists the n-th smallest sum has (i + 1)(j + 1) <= n, so only such places of
    the sorted grid are compared: what a multi-sequence traversal can reach in n steps.
    """
    first, second = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
    i, j = reachable(one.shape[1], two.shape[1], visits)
    sums = np.take_along_axis(one, first, 1)[:, i] + np.take_along_axis(two, second, 1)[:, j]
    order = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return first[np.arange(len(one))[:, None], i[order]] * two.shape[1] + second[np.arange(len(one))[:, None], j[order]]


def nearer_cells(one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each row how many cells have a sum of at most the target's: its rank in the traversal."""
    out = np.zeros(len(one), np.int64)
    for r in range(len(one)):
        i, j = divmod(int(target[r]), two.shape[1])
        out[r] = np.searchsorted(np.sort(two[r]), one[r, i] + two[r, j] - one[r] + 1e-12, side="right").sum()
    return out


class Index:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float) -> None:
        self.dim = sample.shape[1] if len(sample) else 0
        self.half = self.dim // 2
        self.k = self.visits = 1
        if self.dim < 2 or len(sample) < 4:
            return
        rng = np.random.default_rng(SEED)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.k = int(np.clip(2 ** np.floor(np.log2(np.sqrt(n / CELL))), 4, max(len(sample) // FIT, 4)))
        self.books = kmeans(unit[:, : self.half], self.k, rng), kmeans(unit[:, self.half :], self.k, rng)
        x = unit[:2048]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1)[:, None] * x
        y = cosine * x + np.sqrt(1 - cosine**2) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        rank = nearer_cells(*self.gaps(x), self.cells(y, 1)[:, 0])
        self.visits = int(np.quantile(rank, recall, method="higher"))

    def gaps(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.half], self.books[0]), distances(unit[:, self.half :], self.books[1])

    def cells(self, unit: np.ndarray, visits: int) -> np.ndarray:
        return traverse(*self.gaps(unit), visits)

    def probes(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Per vector the cells it visits, its own first; other lengths than the index's have cell 0 alone."""
        out = np.zeros((len(vectors), self.visits), np.int32)
        fit = [i for i, v in enumerate(vectors) if len(v) == self.dim]
        if self.k > 1 and fit:
            x = np.stack([vectors[i] for i in fit])
            out[fit] = self.cells(x / np.linalg.norm(x, axis=1, keepdims=True), self.visits)
        return out


def visited_cells(items: DataFrame, index: Index) -> DataFrame:
    """(label, size, item, cells): the cells each item visits, its own first."""
    shared = items.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
                cells = shared.value.probes(vectors)
                ends = pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32())
                sizes = pa.array([len(v) for v in vectors], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, batch.column(1), pa.ListArray.from_arrays(ends, pa.array(cells.ravel(), pa.int32()))], names=["label", "size", "item", "cells"])

    return items.select("label", "item", "vector").mapInArrow(run, "label long, size int, item long, cells array<int>").withColumn("cells", F.array_distinct("cells"))


def block(cosine: float):
    """For map_groups: sums of links (kind 0: item, links) and a spanning forest (kind 1: item, item) of the blocks."""

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table | None:
        filed, item, copies = (rows.column(c).to_numpy() for c in ("filed", "item", "copies"))
        vector = rows.column("vector").combine_chunks()
        if isinstance(vector, pa.ChunkedArray):
            vector = vector.chunk(0)
        ends, flat = vector.offsets.to_numpy(), vector.values.to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = np.arange(a, b)
            x, y = at[filed[a:b] == 0], at[filed[a:b] == 1]
            if not len(x) or not len(y):
                continue
            mat = flat[ends[a] : ends[b]].astype(np.float64).reshape(b - a, -1)
            mat = mat / np.abs(mat).max(axis=1, keepdims=True)
            norm = np.sqrt((mat * mat).sum(axis=1))
            links = np.zeros(b - a, np.int64)
            edges = []
            for k in range(0, len(x), 256):
                part = x[k : k + 256]
                cos = (mat[part - a] @ mat[y - a].T) / (norm[part - a][:, None] * norm[y - a][None, :])
                i, j = np.nonzero((cos >= cosine) & (item[part][:, None] < item[y][None, :]))
                p, q = part[i], y[j]
                if not len(p):
                    continue
                np.add.at(links, p - a, copies[q])
                np.add.at(links, q - a, copies[p])
                edges.append(forest(item[p], item[q]))
            hit = np.flatnonzero(links)
            if len(hit):
                out.append((np.zeros(len(hit), np.int32), item[a + hit], links[hit]))
                e = forest(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
                out.append((np.ones(len(e[0]), np.int32), *e))
        if not out:
            return None
        return pa.table({n: np.concatenate([o[k] for o in out]) for k, n in enumerate(("kind", "a", "b"))})

    return run


def blocks_of(visited: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """(keys, i, j, filed, item): the blocks that each item is compared in, as one of those filed there or as a probe."""
    filed = visited.select("label", "size", "item", F.col("cells")[0].alias("cell"), F.lit(1).alias("filed"))
    rows = filed.unionByName(visited.select("label", "size", "item", F.explode("cells").alias("cell"), F.lit(0).alias("filed")))
    counts = cut(
        rows.groupBy(*keys)
        .agg(F.sum("filed").alias("n"), F.sum(1 - F.col("filed")).alias("m"))
        .where("n > 0")
        .select(*keys, (F.col("n") + F.col("m")).alias("held"), F.ceil(F.col("n") / chunk).cast("int").alias("tall"), F.ceil(F.col("m") / chunk).cast("int").alias("wide"))
    )
    spot = lambda count: F.pmod(F.xxhash64("item"), F.col(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    return (
        join_counted(rows, counts, keys, "held", "item")
        .withColumn("i", F.explode(F.when(F.col("filed") == 1, F.array(spot("tall"))).otherwise(every("tall"))))
        .withColumn("j", F.explode(F.when(F.col("filed") == 1, every("wide")).otherwise(F.array(spot("wide")))))
        .select(*keys, "i", "j", "filed", "item")
    )


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    number = F.col("label").cast("long") if vectors.schema[label].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label")
    rows = cut(
        vectors.select(F.monotonically_increasing_id().alias("row"), vectors[key].alias("key"), vectors[label].alias("label"), vectors[vector].alias("vector"))
        .withColumn(
            "usable",
            F.coalesce(
                F.col("key").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0),
                F.lit(False),
            ),
        )
        .withColumn("label", number)
    )
    usable = rows.where("usable")
    items = cut(usable.groupBy("label", "vector").agg(F.min("row").alias("item"), F.count("*").alias("copies")))
    sizes = items.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 0
    fitted = items.where(F.size("vector") == dim).orderBy(F.xxhash64("item")).limit(sample).select(F.col("vector").cast("array<double>").alias("vector")).toArrow().column("vector")
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in fitted.chunks] or [np.zeros(0)])
    index = Index(flat.reshape(len(fitted), dim), sizes["n"] if sizes else 0, cosine, recall)
    keys = ["label", "size", "cell"]
    placed = blocks_of(cut(visited_cells(items, index)), keys, CHUNK).join(items.select("item", "copies", "vector"), "item")
    found = cut(map_groups(placed, [*keys, "i", "j"], block(cosine), "kind int, a long, b long", rows=16_384))
    links = found.where("kind = 0").groupBy(F.col("a").alias("item")).agg(F.sum("b").alias("links"))
    parts = components(found.where("kind = 1").select("a", "b"))
    labelled = cut(
        items.join(links, "item", "left").join(parts, F.col("item") == F.col("node"), "left").select("label", "vector", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "item").alias("component"))
    )
    members = join_counted(usable.select("row", "key", "label", "vector"), labelled, ["label", "vector"], "copies", "row")
    members = cut(members.select("row", "key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component"))
    least = cut(members.groupBy("component").agg(F.min("key").alias("component_id"), F.count("*").alias("n")))
    answer = join_counted(members.drop("key"), least, ["component"], "n", "row").select("row", "n_links", "component_id")
    return rows.select("row", "key").join(answer, "row", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "key") == F.col("key"), F.lit(True)).alias("kept"),
    )
