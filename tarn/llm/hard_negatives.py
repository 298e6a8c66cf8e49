"""Operator 12: hard-negative mining by dual-tree search.

A component x counts as floor(256 x) and a row's score is its inner product with the anchor,
an exact integer.  An anchor's positives are the ``positives`` rows of its label with the
highest scores; its negatives for a positive are the ``negatives`` highest rows of other labels
whose score lies between ``low`` and ``high`` hundredths of the positive's.

Candidates are filed in the leaves of a tree of balls.  Its splits come from a bounded sample
of at most ``SAMPLE`` components (``LEAVES`` leaves at most); then every row is routed to a
leaf, and centres and radii are sums and maxima over all rows, so the search is exact.  The
anchors, a stated query set, are sorted by leaf and cut into groups that carry trees of their
own.  From the pair of roots on, a pair of nodes with centres p, c and radii r, s can only
have inner products within p.c -+ (r|c| + s|p| + rs).  A pair whose interval lies below every
score that its anchors still look for, or above their bands, is pruned with its whole group
of anchors; otherwise the larger node is split.  Pairs of leaves are scored exactly, in blocks
of candidates by groups of anchors, which are spread over all tasks whatever their leaf.

Each search runs twice: the leaves nearest to each group give every anchor a score that its
results reach at least, then the traversal visits what may still reach it.

Rows with a null key, label or vector, or a null or non-finite component take no part; nor do
those whose squared length is 2^62 or more, whose scores a long can't hold.  Vectors are
compared with those of their length only; each length is a search of its own.  Equal scores go by the smaller key; rows that repeat a key are rows of their own, so
repeated anchors repeat their results.  Anchors with a positive score of 0 look for 0, below
that for nothing.  Empty vectors score 0; very long vectors make the tree shallower.  Other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import arrow_schema, cut, map_groups

#: Components of the sample at most, leaves of the candidates' tree at most, and rows of a leaf on average.
SAMPLE = 1 << 21
LEAVES = 4096
LEAF = 512
#: Candidates of a block, anchors of a group, anchors whose groups share a tree.
BLOCK = 2048
GROUP = 64
UNIT = 4096
#: Rows in the leaves that a group looks at first, at least.
FIRST = 1024
MOST = 1 << 62


class Balls:
    """A binary tree as arrays: children (-1 in leaves), leaf number, centre, radius."""

    def __init__(self, left: list[int], right: list[int], leaf: list[int], centre: np.ndarray, radius: np.ndarray) -> None:
        self.left, self.right, self.leaf = (np.asarray(x, np.int64) for x in (left, right, leaf))
        self.centre, self.radius = centre, radius
        self.norm = np.sqrt((centre**2).sum(axis=1))


def split(x: np.ndarray, size: int) -> tuple[list[tuple[int, int, np.ndarray, float]], list[np.ndarray]]:
    """Nodes (left, right, direction, cut) and the leaves' rows; at each node the side of the median along the widest of two far points."""
    nodes: list[tuple[int, int, np.ndarray, float]] = []
    leaves: list[np.ndarray] = []

    def grow(at: np.ndarray) -> int:
        part = x[at]
        if len(at) > size:
            far = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            along = part @ (other - far)
            middle = float(np.median(along))
            low = along <= middle
            if low.all():
                low = along < middle
            if low.any() and not low.all():
                me = len(nodes)
                nodes.append((0, 0, other - far, float((along[low].max() + along[~low].min()) / 2)))
                a, b = grow(at[low]), grow(at[~low])
                nodes[me] = (a, b, *nodes[me][2:])
                return me
        leaves.append(at)
        return -len(leaves)

    grow(np.arange(len(x)))
    return nodes, leaves


def route(nodes: list[tuple[int, int, np.ndarray, float]], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(len(x), np.int64)

    def go(node: int, at: np.ndarray) -> None:
        if node < 0:
            out[at] = -node - 1
        elif len(at):
            left, right, along, cut_at = nodes[node]
            low = x[at] @ along <= cut_at
            go(left, at[low])
            go(right, at[~low])

    if nodes:
        go(0, np.arange(len(x)))
    return out


def balls(nodes: list[tuple[int, int, np.ndarray, float]], centre: np.ndarray, radius: np.ndarray, count: np.ndarray) -> Balls:
    """The tree over leaves with the given centres and radii; leaves without rows have the count 0 and are never reached."""
    n = len(nodes)
    centres = np.zeros((n + len(count), centre.shape[1]))
    radii = np.full(n + len(count), -1.0)
    weight = np.zeros(n + len(count))
    centres[n:], radii[n:], weight[n:] = centre, np.where(count > 0, radius, -1.0), count
    spot = lambda k: k if k >= 0 else n - k - 1
    left, right = [spot(a) for a, *_ in nodes], [spot(b) for _, b, *_ in nodes]
    for k in range(n - 1, -1, -1):
        both = [c for c in (left[k], right[k]) if weight[c] > 0]
        if both:
            weight[k] = sum(weight[c] for c in both)
            centres[k] = sum(weight[c] * centres[c] for c in both) / weight[k]
            radii[k] = max(np.sqrt(((centres[c] - centres[k]) ** 2).sum()) + radii[c] for c in both)
    return Balls([*left, *[-1] * len(count)], [*right, *[-1] * len(count)], [*[-1] * n, *range(len(count))], centres, radii * (1 + 1e-9) + 1e-9 * (radii >= 0))


def dual(anchors: Balls, candidates: Balls, wanted: np.ndarray, capped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (group, leaf) that may hold scores from ``wanted`` to ``capped``, given per node of the anchors."""
    a = b = np.zeros(1, np.int64)
    found = []
    while len(a):
        live = candidates.radius[b] >= 0
        a, b = a[live], b[live]
        if not len(a):
            break
        middle = np.einsum("nd,nd->n", anchors.centre[a], candidates.centre[b])
        reach = anchors.radius[a] * candidates.norm[b] + candidates.radius[b] * anchors.norm[a] + anchors.radius[a] * candidates.radius[b]
        reach += 1e-9 * (1 + np.abs(middle) + anchors.norm[a] * candidates.norm[b])
        keep = (middle + reach >= wanted[a]) & (middle - reach <= capped[a])
        a, b = a[keep], b[keep]
        one, two = anchors.left[a] < 0, candidates.left[b] < 0
        done = one & two
        found.append((anchors.leaf[a[done]], candidates.leaf[b[done]]))
        a, b, one, two = a[~done], b[~done], one[~done], two[~done]
        first = two | (~one & (anchors.radius[a] >= candidates.radius[b]))
        a, b = (
            np.concatenate([anchors.left[a[first]], anchors.right[a[first]], a[~first], a[~first]]),
            np.concatenate([b[first], b[first], candidates.left[b[~first]], candidates.right[b[~first]]]),
        )
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point while no sum can round, else in integers."""
    x, y = (float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for m in (a, b))
    if x * y * max(a.shape[1], 1) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lists_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def prepared(vectors: DataFrame, key: str, vector: str, label: str, anchors: F.Column) -> DataFrame:
    """(row, key, label, anchor, dim, vector): the rows that take part, as integers; ``anchors`` is a predicate on key."""
    scaled = F.transform(F.col("vector").cast("array<double>"), lambda v: F.floor(v * 256))
    number = F.col("label").cast("long") if vectors.schema[label].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label")
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**23 * (1 << 30)))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), vectors[key].cast("long").alias("key"), vectors[label].alias("label"), vectors[vector].alias("vector"))
    rows = rows.where("key is not null and label is not null and vector is not null").where(usable).withColumn("label", number)
    length = F.aggregate("vector", F.lit(0.0), lambda s, v: s + F.floor(v.cast("double") * 256).cast("double") * F.floor(v.cast("double") * 256).cast("double"))
    return cut(rows.where(length < float(MOST)).select("row", "key", "label", F.coalesce(anchors, F.lit(False)).alias("anchor"), F.size("vector").alias("dim"), scaled.alias("vector")))


class Search:
    """The candidates' tree of one vector length, and the blocks its leaves lie in."""

    def __init__(self, rows: DataFrame, dim: int, count: int) -> None:
        self.dim = dim
        self.spark = rows.sparkSession
        leaves = int(np.clip(count // LEAF, 1, LEAVES))
        sample = max(min(SAMPLE // max(dim, 1), 8 * leaves), 1)
        taken = rows.orderBy(F.xxhash64("row")).limit(sample).select("vector").toArrow().column("vector")
        self.nodes, kept = split(lists_of(taken, dim).astype(np.float64), max(len(taken) // leaves, 1)) if dim and len(taken) else ([], [0])
        shared = self.spark.sparkContext.broadcast(self.nodes)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = route(shared.value, lists_of(batch.column(4), dim).astype(np.float64)) if dim else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["row", "key", "label", "anchor", "vector", "leaf"])

        self.rows = cut(rows.select("row", "key", "label", "anchor", "vector").mapInArrow(file, "row long, key long, label long, anchor boolean, vector array<long>, leaf long"))
        # Centres are means and radii maxima over all rows of a leaf; there are LEAVES leaves at most.
        sums = self.rows.mapInArrow(self._sums(dim), "leaf long, n long, total array<double>")
        add = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), dim), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        stats = {r["leaf"]: r for r in sums.groupBy("leaf").agg(F.sum("n").alias("n"), add.alias("total")).collect()}
        self.count = np.array([stats[k]["n"] if k in stats else 0 for k in range(len(kept))])
        self.centre = np.array([np.asarray(stats[k]["total"]) / stats[k]["n"] if k in stats else np.zeros(dim) for k in range(len(kept))]).reshape(len(kept), dim)
        spread = self.spark.sparkContext.broadcast(self.centre)

        def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = batch.column(0).to_numpy()
                far = np.sqrt(((lists_of(batch.column(1), dim) - spread.value[leaf]) ** 2).sum(axis=1))
                kinds, back = np.unique(leaf, return_inverse=True)
                most = np.zeros(len(kinds))
                np.maximum.at(most, back, far)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(most)], names=["leaf", "far"])

        radius = dict(self.rows.select("leaf", "vector").mapInArrow(gaps, "leaf long, far double").groupBy("leaf").agg(F.max("far")).collect())
        self.tree = balls(self.nodes, self.centre, np.array([radius.get(k, 0.0) for k in range(len(kept))]), self.count)
        self.chunks = np.maximum(-(-self.count // BLOCK), 1)

    @staticmethod
    def _sums(dim: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                x, leaf = lists_of(batch.column(4), dim).astype(np.float64), batch.column(5).to_numpy()
                for k in np.unique(leaf).tolist():
                    n, s = total.get(k, (0, np.zeros(dim)))
                    total[k] = (n + int((leaf == k).sum()), s + x[leaf == k].sum(axis=0))
            ends = np.arange(len(total) + 1) * dim
            flat = np.concatenate([s for _, s in total.values()]) if total else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n for n, _ in total.values()], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["leaf", "n", "total"])

        return run

    def visits(self, anchors: DataFrame, first: bool) -> DataFrame:
        """(leaf, group, anchors): groups of anchors with the leaves they visit.

        anchors: (row, label, leaf, vector, wants) with wants (low, high) spans of scores still
        looked for.  First: the leaves with the highest products of centres only.
        """
        dim = self.dim
        shared = self.spark.sparkContext.broadcast((self.tree, self.centre, self.count))
        schema = arrow_schema("leaf long, group long, item array<long>, label array<long>, vector array<long>, many array<int>, low array<long>, high array<long>")

        def unit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            tree, centre, count = shared.value
            row, label = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            x = lists_of(rows.column(2), dim)
            wants = rows.column(3).to_pylist()
            nodes, leaves = split(x.astype(np.float64), GROUP)
            leaves = [at[k : k + GROUP] for at in leaves for k in range(0, len(at), GROUP)] if not nodes else leaves
            middle = np.array([x[at].mean(axis=0) for at in leaves]).reshape(len(leaves), dim)
            if first:
                order = np.argsort(-(middle @ centre.T), axis=1, kind="stable")
                enough = np.cumsum(count[order], axis=1)
                spots = [(g, int(leaf)) for g in range(len(leaves)) for leaf in order[g, : int(np.searchsorted(enough[g], FIRST)) + 1] if count[leaf]]
            else:
                reach = np.array([np.sqrt(((x[at] - m) ** 2).sum(axis=1).max()) for at, m in zip(leaves, middle, strict=True)])
                low = np.array([min((w["low"] for i in at for w in wants[i]), default=MOST) for at in leaves], float)
                high = np.array([max((w["high"] for i in at for w in wants[i]), default=-MOST) for at in leaves], float)
                if nodes:
                    own = balls(nodes, middle, reach, np.array([len(at) for at in leaves]))
                    spread = np.concatenate([np.zeros(len(nodes)), low]), np.concatenate([np.zeros(len(nodes)), high])
                    for k in range(len(nodes) - 1, -1, -1):
                        spread[0][k] = min(spread[0][own.left[k]], spread[0][own.right[k]])
                        spread[1][k] = max(spread[1][own.left[k]], spread[1][own.right[k]])
                    spots = list(zip(*(v.tolist() for v in dual(own, tree, *spread)), strict=True))
                else:
                    spots = []
                    for g in range(len(leaves)):
                        own = Balls([-1], [-1], [g], middle[[g]], reach[[g]] * (1 + 1e-9) + 1e-9)
                        spots += zip(*(v.tolist() for v in dual(own, tree, low[[g]], high[[g]])), strict=True)
            for a in range(0, len(spots), 256):
                part = spots[a : a + 256]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "leaf": leaf,
                            "group": int(row[leaves[g][0]]),
                            "item": row[leaves[g]].tolist(),
                            "label": label[leaves[g]].tolist(),
                            "vector": x[leaves[g]].ravel().tolist(),
                            "many": [len(wants[i]) for i in leaves[g]],
                            "low": [w["low"] for i in leaves[g] for w in wants[i]],
                            "high": [w["high"] for i in leaves[g] for w in wants[i]],
                        }
                        for g, leaf in part
                    ],
                    schema=schema,
                )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                while sum(b.num_rows for b in held) >= UNIT:
                    whole = pa.Table.from_batches(held)
                    yield from unit(whole.slice(0, UNIT))
                    held = whole.slice(UNIT).to_batches()
            if sum(b.num_rows for b in held):
                yield from unit(pa.Table.from_batches(held))

        ddl = "leaf long, group long, item array<long>, label array<long>, vector array<long>, many array<int>, low array<long>, high array<long>"
        placed = anchors.repartitionByRange("leaf", "row").sortWithinPartitions("leaf", "row").select("row", "label", "vector", "wants")
        return placed.mapInArrow(run, ddl)

    def scored(self, visits: DataFrame, same: bool, keep: int) -> DataFrame:
        """(item, want, score, key, row): of each block and span the ``keep`` highest rows with the anchor's label, or with others."""
        dim = self.dim
        visits = cut(visits)
        held = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        groups = max(BLOCK // GROUP, 1)
        tall = self.spark.createDataFrame([(k, int(c), max(-(-held.get(k, 0) // groups), 0)) for k, c in enumerate(self.chunks.tolist())], "leaf long, tall int, wide int").where("wide > 0")
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        spot = lambda of, c: F.pmod(F.xxhash64(of), F.col(c)).cast("int")
        blank = [F.lit(None).cast(t).alias(n) for n, t in (("item", "array<long>"), ("labels", "array<long>"), ("many", "array<int>"), ("low", "array<long>"), ("high", "array<long>"))]
        ours = self.rows.join(F.broadcast(tall), "leaf").select("leaf", spot("row", "tall").alias("i"), F.explode(every("wide")).alias("j"), F.lit(0).alias("side"), "row", "key", "label", "vector", *blank)
        theirs = visits.join(F.broadcast(tall), "leaf").select(
            "leaf", F.explode(every("tall")).alias("i"), spot("group", "wide").alias("j"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("blank"), "vector", "item", "label", "many", "low", "high"
        )
        both = ours.union(theirs)

        def best_of(item: np.ndarray, mine: np.ndarray, x: np.ndarray, many: np.ndarray, low: np.ndarray, high: np.ndarray, y: np.ndarray, label: np.ndarray, key: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
            score = products(x, y)
            fits = (mine[:, None] == label[None, :]) == same
            if same:
                fits &= item[:, None] != row[None, :]
            who = np.repeat(np.arange(len(item)), many)
            want = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            w, j = np.nonzero(fits[who] & (score[who] >= low[:, None]) & (score[who] <= high[:, None]))
            s = score[who[w], j]
            order = np.lexsort((row[j], key[j], -s, w))
            w, j, s = w[order], j[order], s[order]
            top = np.arange(len(w)) - np.searchsorted(w, w) < keep
            w, j, s = w[top], j[top], s[top]
            return [item[who[w]], want[w].astype(np.int64), s, key[j], row[j]]

        def block(rows: pa.Table, bounds: np.ndarray) -> pa.Table | None:
            out: list[list[np.ndarray]] = []
            side = rows.column("side").to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                at = a + np.flatnonzero(side[a:b] == 0)
                if not len(at) or len(at) == b - a:
                    continue
                part = rows.take(pa.array(at))
                y, label, key, row = lists_of(part.column("vector"), dim), part.column("label").to_numpy(), part.column("key").to_numpy(), part.column("row").to_numpy()
                for g in (a + np.flatnonzero(side[a:b] == 1)).tolist():
                    item, mine, many, low, high = (np.asarray(rows.column(c)[g].as_py(), np.int64) for c in ("item", "labels", "many", "low", "high"))
                    x = np.asarray(rows.column("vector")[g].values.to_numpy(), np.int64).reshape(len(item), dim)
                    ends = np.cumsum(many)
                    for k in range(0, len(item), GROUP):
                        spans = slice(ends[k] - many[k], ends[min(k + GROUP, len(item)) - 1])
                        some = slice(k, k + GROUP)
                        out.append(best_of(item[some], mine[some], x[some], many[some], low[spans], high[spans], y, label, key, row))
            if not out:
                return None
            return pa.table({n: np.concatenate([o[k] for o in out]) for k, n in enumerate(("item", "want", "score", "key", "row"))})

        found = map_groups(both, ["leaf", "i", "j"], block, "item long, want long, score long, key long, row long", rows=8192)
        best = Window.partitionBy("item", "want").orderBy(F.desc("score"), "key", "row")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)


def mine(vectors: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a predicate on the column ``key``.  A negative's score s and its positive's p
    satisfy low p <= 100 s <= high p.
    """
    rows = prepared(vectors, key, vector, label, anchors)
    answer = None
    for size in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("anchor").alias("m")).where("m > 0").orderBy("dim").collect():
        found = _mine(Search(rows.where(F.col("dim") == size["dim"]), size["dim"], size["n"]), positives, negatives, low, high)
        answer = found if answer is None else answer.unionByName(found)
    if answer is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return answer


def _mine(search: Search, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    anchors = search.rows.where("anchor").select("row", "key", "label", "leaf", "vector")
    span = lambda a, b: F.struct(F.greatest(a, F.lit(-MOST)).alias("low"), b.alias("high"))
    one = F.array(span(F.lit(-MOST), F.lit(MOST)))
    seen = search.scored(search.visits(anchors.withColumn("wants", one), True), True, positives)
    reached = seen.groupBy("item").agg(F.when(F.count("*") >= positives, F.min("score")).alias("reached"))
    near = anchors.join(reached, F.col("row") == F.col("item"), "left").drop("item")
    wanted = near.withColumn("wants", F.array(span(F.coalesce("reached", F.lit(-MOST)), F.lit(MOST)))).drop("reached")
    best = cut(search.scored(search.visits(wanted, False), True, positives))
    # Bands of whole scores: from the rounded-up lower bound to the rounded-down upper one.
    exact = lambda percent: F.col("score").cast("decimal(38,0)") * percent / 100
    band = span(F.ceil(exact(low)).cast("long"), F.floor(exact(high)).cast("long"))
    listed = best.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", band.alias("band")))).alias("bands"))
    with_bands = anchors.join(listed, F.col("row") == F.col("item")).drop("item").withColumn("wants", F.transform("bands", lambda b: b["band"])).drop("bands")
    seen = search.scored(search.visits(with_bands, True), False, negatives)
    reached = seen.groupBy("item", "want").agg(F.count("*").alias("n"), F.min("score").alias("reached")).where(F.col("n") >= negatives).groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("want", "reached"))).alias("reached"))
    raised = with_bands.join(reached, F.col("row") == F.col("item"), "left").drop("item")
    higher = F.transform("wants", lambda w, i: span(F.greatest(w["low"], F.coalesce(F.try_element_at("reached", i.cast("long")), w["low"])), w["high"]))
    found = search.scored(search.visits(raised.withColumn("wants", F.when(F.col("reached").isNull(), F.col("wants")).otherwise(higher)).drop("reached"), False), False, negatives)
    pairs = best.select("item", (F.col("rank") - 1).cast("long").alias("want"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.select("item", "want", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["item", "want"])
    return named.join(anchors.select(F.col("row").alias("item"), F.col("key").alias("anchor_id")), "item").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
