"""Helpers shared by the numbered operators: tables, lineage cuts, grouped streaming, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text a Python task works on at once; one longer text is a piece of its own.
PIECE_CHARS = 2_000_000
#: A key with more than one in so many rows is joined by broadcast; there are fewer than this.
HEAVY = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; only a local session that names none gets one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column has (names are equal whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; for wide rows, which a checkpoint would hold as they are."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about PIECE_CHARS of text each."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()):
            size += n
            if size >= PIECE_CHARS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The slices, and their texts; only these become Python strings at once.  A null text counts as empty."""
    for batch in slices(batches, text):
        yield batch, [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], n: str, spread: str) -> DataFrame:
    """The inner join of ``big`` with ``small``, whose keys are unique; no key's rows meet in one task.

    ``n`` of small says how many rows of big hold the key; small must be cheap to read twice.
    Keys that hold more than one row in ``HEAVY`` are fewer than ``HEAVY``, whatever the data,
    so they are broadcast; the rows that they settle are dealt over all tasks by ``spread``.
    """
    total, most = small.agg(F.sum(n), F.max(n)).first()
    if not total or most <= max(total // HEAVY, HEAVY):
        return big.join(small, keys)
    value = F.struct(*[c for c in small.columns if c not in keys])
    heavy = F.col(n) > max(total // HEAVY, HEAVY)
    first = big.join(F.broadcast(small.where(heavy).select(*keys, value.alias("heavy_value"))), keys, "left")
    salted = first.withColumn("salt", F.when(F.col("heavy_value").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int"))
    # Always 0, but not as a constant: the optimizer would take a constant out of the join's keys.
    none = F.pmod(F.col(n), F.lit(1)).cast("int")
    light = small.where(~heavy).select(*keys, none.alias("salt"), value.alias("light_value"))
    both = salted.join(light, [*keys, "salt"], "left").withColumn("value", F.coalesce("heavy_value", "light_value"))
    return both.where("value is not null").select(*big.columns, "value.*")


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType, StructType

    parsed = DataType.fromDDL(ddl)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal rows, with the number of rows at the end."""
    n = len(columns[0])
    if n == 0:
        return np.array([0])
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def map_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table | None],
    ddl: str,
    rows: int = 65_536,
) -> DataFrame:
    """Call ``fn(table, bounds)`` on whole groups of equal (integer, not null) keys.

    Rows are shuffled by the keys and sorted; a task streams its partition and hands over
    many whole groups at a time, so small groups cost no call each.  A group must fit in a
    task: callers split larger ones by a chunk number in the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        n = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            whole = pa.Table.from_batches(held)
            bounds = group_bounds([whole.column(k).to_numpy() for k in keys])
            if not final:
                held = whole.slice(int(bounds[-2])).to_batches()
                n = whole.num_rows - int(bounds[-2])
                whole, bounds = whole.slice(0, int(bounds[-2])), bounds[:-1]
            if whole.num_rows and (out := fn(whole.combine_chunks(), bounds)) is not None:
                yield from out.to_batches()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            ends = [tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys) for b, i in ((batch, 0), (batch, batch.num_rows - 1))]
            if n >= rows and (last is None or ends[0] != ends[1] or ends[1] != last):
                yield from flush(False)
            last = ends[1]
        if held:
            yield from flush(True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with the edges (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _local_forest(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 40, forests: DataFrame | None = None) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps; every step is an aggregation and a join,
    so a node with many neighbours is never gathered in a task.  Edges with a null end or
    equal ends are left out; no edges give no rows.  forests: more edges, which Python has
    reduced to forests already, so that no task runs two Python workers for them.
    """
    clean = _local_forest(edges.where("a <> b"))
    clean = (clean if forests is None else clean.unionByName(forests.select("a", "b"))).where("a <> b")
    now = cut(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
