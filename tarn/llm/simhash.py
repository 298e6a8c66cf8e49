"""Operator 1: SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64 bits, the majority over the hashes of word shingles.  Equal fingerprints
are one item.  To find all pairs within ``distance`` bits, correlated bits are grouped into
partitions; a partition i gets a threshold t_i, the sum of t_i + 1 being distance + 1, so any
linked pair differs by at most t_i bits in some partition.  Thresholds, and the number of
partitions, come from dynamic programming on expected candidate counts; what is expected
follows from the frequencies of all bits and pairs of bits over all fingerprints.  Each fingerprint is filed under its value in every
partition and probes all values within the partition's threshold; candidates are verified.

A value that many fingerprints share goes another way: its fingerprints and probes are split
into chunks, pairs of chunks are compared in blocks, and a block reports only a spanning
forest of the links it found.  So the output is linear in the fingerprints, and no group is
gathered whole or listed as pairs.  Links are exact either way.

Null and empty texts have fingerprint zero and are linked like others; repeated rows and null
keys are rows of their own (a null key never names a component); very long texts are read whole,
their hashes 65,536 at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import components, cut, forest, join_counted, map_groups, pieces

SEED = 42
SHINGLE = 4
DISTANCE = 4
BITS = 64
#: A value shared by more fingerprints than this is compared in blocks.
HOT = 64
CHUNK = 2048
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    spans = zip(begin[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    hashes = np.array([h(flat[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): every row with its fingerprint as a signed long; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_fingerprint(t, shingle) for t in texts], pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, fp long")


def bit_counts(items: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits in how many both are set (64 x 64, whatever the data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 65_536):
                total += bits[at : at + 65_536].T @ bits[at : at + 65_536]
            n += len(bits)
        place = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total.ravel(), n))], names=["place", "n"])

    rows = items.select("fp").mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas().sort_values("place")["n"].to_numpy()
    if not len(rows):
        return 0, np.zeros((BITS, BITS))
    return int(rows[-1]), rows[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; a group takes the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left = set(range(BITS))
    out = []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (spread[b], -b))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (correlation[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        out.append(sorted(group))
    return out


def differing(n: int, both: np.ndarray, bits: list[int]) -> tuple[float, float]:
    """Mean and variance of the number of the bits in which two fingerprints, drawn by the same frequencies, differ.

    Two bits differ together if one fingerprint holds 11 and the other 00 there, or one 10 and
    the other 01: so the variance has the correlations of all pairs of bits.
    """
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    together = 2 * (p11 * (1 - p[:, None] - p[None, :] + p11) + p10 * p01)
    q = 2 * p * (1 - p)
    np.fill_diagonal(together, q)
    return float(q.sum()), float((together - np.outer(q, q)).sum())


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t up to ``most``: the chance that two fingerprints differ in at most t of the bits.

    A beta-binomial distribution with the mean and the variance that ``differing`` gives: bits
    that go together make both few and many differences likelier than bits on their own would.
    """
    m = len(bits)
    mean, variance = differing(n, both, bits)
    rate = mean / m
    if not 0 < rate < 1:
        return [float(rate <= 0)] * (most + 1)
    shared = 0.0 if m == 1 else min(max((variance / (m * rate * (1 - rate)) - 1) / (m - 1), 0.0), 0.999)
    if shared < 1e-6:
        chance = [math.comb(m, t) * rate**t * (1 - rate) ** (m - t) for t in range(min(most, m) + 1)]
    else:
        a, b = rate * (1 - shared) / shared, (1 - rate) * (1 - shared) / shared
        beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        chance = [math.comb(m, t) * math.exp(beta(t + a, m - t + b) - beta(a, b)) for t in range(min(most, m) + 1)]
    total = np.minimum(np.cumsum(chance), 1).tolist()
    return total + [total[-1]] * (most + 1 - len(total))


def allocate(n: int, both: np.ndarray, distance: int = DISTANCE, probe_cost: float = 4.0) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds (-1: not probed), the cheapest over 2 to distance + 2 partitions."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, distance + 3):
        groups = group_bits(n, both, parts)
        cost = []
        for g in groups:
            chance = within(n, both, g, distance)
            probes = np.cumsum([float(len(list(itertools.combinations(range(len(g)), t)))) if t < 4 else 1e9 for t in range(distance + 1)])
            cost.append([0.0, *(n * (n * c / 2 + probe_cost * w) for c, w in zip(chance, probes, strict=True))])
        # cheapest[s]: cost and choices of the groups so far with thresholds plus one summing to s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in cheapest.items():
                for t, more in enumerate(row):
                    if s + t <= distance + 1 and (s + t not in step or c + more < step[s + t][0]):
                        step[s + t] = (c + more, [*chosen, t - 1])
            cheapest = step
        total, chosen = cheapest[distance + 1]
        if best is None or total < best[0]:
            best = (total, list(zip(groups, chosen, strict=True)))
    assert best is not None
    return best[1]


def signatures(items: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """(part, value, fp): each fingerprint under its value in every partition, or under all values its probes visit."""
    masks = []
    for bits, threshold in plan:
        flips = [c for t in range(1, threshold + 1) for c in itertools.combinations(bits, t)] if probing else []
        whole = sum(1 << b for b in bits)
        masks.append((threshold >= 0, np.uint64(whole), np.array([0, *(sum(1 << b for b in c) for c in flips)], np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                fp = fps[at : at + 4096]
                for k, (used, whole, flips) in enumerate(masks):
                    if used:
                        value = ((fp.view(np.uint64) & whole)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                        out = np.repeat(fp, len(flips))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), k, np.int32)), pa.array(value), pa.array(out)], names=["part", "value", "fp"])

    return items.select("fp").mapInArrow(run, "part int, value long, fp long")


def block_links(distance: int):
    """For map_groups over (part, value, i, j): a spanning forest of the links between the filed and the probing chunk."""

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table | None:
        fp, filed = rows.column("fp").to_numpy(), rows.column("filed").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x, y = (np.unique(fp[a:b][filed[a:b] == side]) for side in (1, 0))
            if not len(x) or not len(y):
                continue
            pairs = []
            for at in range(0, len(x), 256):
                # Of signed numbers bitwise_count counts the absolute value's bits.
                near = np.bitwise_count((x[at : at + 256, None] ^ y[None, :]).view(np.uint64)) <= distance
                i, j = np.nonzero(near)
                i, j = x[at + i], y[j]
                pairs.append(forest(i[i != j], j[i != j]))
            found.append(forest(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])))
        if not found:
            return None
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return run


def link_edges(items: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    cold, hot = _links_and_forests(items, distance)
    return cold.unionByName(hot)


def _links_and_forests(items: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Links under values that few fingerprints share, and spanning forests of the links under the others."""
    n, both = bit_counts(items)
    plan = allocate(n, both, distance)
    filed, probes = signatures(items, plan, False), signatures(items, plan, True)
    heavy = cut(filed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    cold = filed.join(heavy, ["part", "value"], "left_anti").alias("f").join(
        probes.alias("p"), (F.col("f.part") == F.col("p.part")) & (F.col("f.value") == F.col("p.value")) & (F.col("f.fp") != F.col("p.fp")) & (F.bit_count(F.col("f.fp").bitwiseXOR(F.col("p.fp"))) <= distance)
    ).select(F.col("f.fp").alias("a"), F.col("p.fp").alias("b"))
    counted = probes.join(heavy, ["part", "value"]).select("part", "value", "fp", "n")
    wide = counted.groupBy("part", "value").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    chunks = cut(wide.select("part", "value", F.ceil(F.col("n") / CHUNK).cast("int").alias("rows"), F.ceil(F.col("m") / CHUNK).cast("int").alias("columns")))
    spot = lambda count: F.pmod(F.xxhash64("fp"), F.col(count)).cast("int")
    one = filed.join(chunks, ["part", "value"]).select("part", "value", spot("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), "fp", F.lit(1).alias("filed"))
    two = probes.join(chunks, ["part", "value"]).select("part", "value", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), spot("columns").alias("j"), "fp", F.lit(0).alias("filed"))
    hot = map_groups(one.unionByName(two), ["part", "value", "i", "j"], block_links(distance), "a long, b long")
    return cold, hot


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, key, fingerprint, component_id, kept) of every row.

    component_id is the smallest key reachable over links; kept is the row with the smallest
    key (null keys last) and row number of its component.  row names a column of row numbers,
    else the place in the scan is taken.
    """
    number = docs[row] if row else F.monotonically_increasing_id()
    source = docs.select(F.struct(number.alias("row"), docs[key].alias("key")).alias("id"), docs[text].alias("text"))
    rows = cut(fingerprints(source, shingle, "id", "text").select("key.*", "fp"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    items = cut(rows.groupBy("fp").agg(first.alias("least"), F.count("*").alias("n")))
    cold, hot = _links_and_forests(items, distance)
    parts = components(cold, forests=hot)
    labelled = cut(items.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component")))
    least = cut(labelled.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("k")))
    by_fp = cut(join_counted(labelled.select("fp", "n", "component"), least, ["component"], "k", "fp").select("fp", "n", "least"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_counted(rows, by_fp, ["fp"], "n", "row").select("row", "key", fingerprint.alias("fingerprint"), F.col("least.key").alias("component_id"), (F.col("least.row") == F.col("row")).alias("kept"))
