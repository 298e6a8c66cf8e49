"""Operator 3: line dedup by pairwise alignment.

A block is a run of adjacent lines with at least ``MIN_WORDS`` words.  Documents overlap if
they share a block.  They are found through rare line hashes: a line of ``MIN_WORDS`` words is
hashed alone; shorter lines, which are frequent, are hashed with the lines behind them, and
with those before, just as many as reach ``MIN_WORDS`` words.  Every block is a union of such
shortest blocks, and each document is paired with the first holder of each of its hashes.  So
the pairs are linear in the lines, whatever many documents share, and no block is missed.

Of a pair the shortest blocks of both documents are aligned with patience diff (a line of
``MIN_WORDS`` words is a block by itself): blocks unique on both sides are matched along their
longest increasing chain, and the gaps between are aligned in turn; where a gap has no such
block, the k-th copy of one side meets the k-th of the other.  Lines of matched blocks are
deleted from the later document, the one with the larger key, wherever the block stands in it.
What an alignment leaves is aligned again, with the earlier document from its start and from
its end by turns, so moved and turned blocks are found in some 4 sqrt(blocks) rounds, until an
alignment matches nothing.  So a line goes if and only if it lies in a block that an earlier
document holds.  The first document keeps its lines.

Lines are compared without the white space around them, by a 64-bit hash; blank lines never
match and lie in no block.  A null text stays null, an empty one empty; a very long text is a
longer list of hashes, and only the lists of the documents in a pair are held.  Null keys come
last, equal keys in the order of the scan; repeated rows are earlier and later documents like
any others.  An empty table gives no rows.  Columns beside key and text are kept, whatever
their names.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarn.llm.common import cut, fresh, join_counted, slices

MIN_WORDS = 8
#: Later documents that one task aligns with the same earlier one.
PARTNERS = 512
#: The white space that ends words and lines' edges.
WHITE = " \t\n\r\x0b\x0c"

#: A block's name: the hash of its line, or the hashes of its lines.
Block = int | tuple[int, ...]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        before.append(ends[k - 1] if k else -1)
    out = []
    at = ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def copies_in_turn(a: list[Block], b: list[Block], i: int, j: int) -> list[tuple[int, int]]:
    """Places of the k-th copy in a with those of the k-th in b, from places i and j on."""
    spots: dict[Block, list[int]] = {}
    for k, x in enumerate(b, j):
        spots.setdefault(x, []).append(k)
    turns = {x: iter(s) for x, s in spots.items()}
    met = ((k, next(turns[x], None)) for k, x in enumerate(a, i) if x in turns)
    return [(k, q) for k, q in met if q is not None]


def align(a: list[Block], b: list[Block]) -> list[tuple[int, int]]:
    """Patience diff: matched places of two sequences, increasing on both sides; none only if they share nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        spot = {x: k for k, x in enumerate(b[j:n], j) if right[x] == 1}
        pairs = [(k, spot[x]) for k, x in enumerate(a[i:m], i) if left[x] == 1 and x in spot]
        pairs = pairs or copies_in_turn(a[i:m], b[j:n], i, j)
        chain = [pairs[k] for k in increasing([q for _, q in pairs])]
        if not chain:
            continue
        x, y = i, j
        for p, q in chain:
            todo.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        todo.append((x, m, y, n))
    return sorted(out)


def shortest_blocks(hashes: list[int], words: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of the shortest blocks that begin or end at some line."""
    stop = total = start = 0
    for start in range(len(hashes)):
        while stop < len(hashes) and total < min_words:
            total += words[stop]
            stop += 1
        if total < min_words:
            break
        yield start, stop
        total -= words[start]
    start = total = 0
    for stop in range(1, len(hashes) + 1):
        total += words[stop - 1]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            yield start, stop


def named_blocks(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, Block]]:
    """(start, stop, name) of the shortest blocks in the order of their places; the name is all of the block's line hashes."""
    spots = sorted(set(shortest_blocks(hashes, words, min_words)))
    return [(i, j, hashes[i] if j == i + 1 else tuple(hashes[i:j])) for i, j in spots]


class Earlier:
    """The earlier document of pairs: its shortest blocks in order, and where each stands."""

    def __init__(self, hashes: list[int], words: list[int], min_words: int) -> None:
        self.min_words = min_words
        self.names = [x for _, _, x in named_blocks(hashes, words, min_words)]
        self.places: dict[Block, list[int]] = {}
        for k, x in enumerate(self.names):
            self.places.setdefault(x, []).append(k)

    def aligned(self, hashes: list[int], words: list[int]) -> list[int]:
        """Places of the lines of a later document that lie in blocks aligned with some of this one."""
        # As in any diff, what only one side has is left out before.
        left = [x for x in named_blocks(hashes, words, self.min_words) if x[2] in self.places]
        gone: set[int] = set()
        turned = False
        while left:
            spots = sorted((p for x in {x[2] for x in left} for p in self.places[x]), reverse=turned)
            matched = {left[p][2] for p, _ in align([x[2] for x in left], [self.names[p] for p in spots])}
            if not matched:
                break
            gone.update(k for i, j, x in left if x in matched for k in range(i, j))
            left = [x for x in left if x[2] not in matched]
            turned = not turned
        return sorted(gone)


def block_hashes(lines: Column, min_words: int) -> Column:
    """The distinct hashes of the shortest blocks of an array of (hash, words)."""

    def folded(part: Column, seed: int) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(seed).cast("long").alias("hash"))
        longer = lambda a, x: F.struct((a["words"] + x["words"]).alias("words"), F.xxhash64(a["hash"], x["hash"]).alias("hash"))
        return F.aggregate(part, start, lambda a, x: F.when(a["words"] >= min_words, a).otherwise(longer(a, x)), lambda a: F.when(a["words"] >= min_words, a["hash"]))

    alone = lambda x: x["words"] >= min_words
    forward = F.transform(lines, lambda x, i: F.when(alone(x), x["hash"]).otherwise(folded(F.slice(lines, i + 1, F.lit(min_words)), 1)))
    back = F.transform(lines, lambda x, i: F.when(~alone(x), folded(F.reverse(F.slice(lines, F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words)))), 2)))
    return F.array_distinct(F.array_compact(F.concat(forward, back)))


def overlaps(sketch: DataFrame) -> DataFrame:
    """(later, earlier): every row with the first holders of its shortest blocks, from (row, rank, blocks)."""
    once = sketch.select("row", "rank", F.explode("blocks").alias("hash"))
    held = cut(once.groupBy("hash").agg(F.count("*").alias("n"), F.min("rank")["row"].alias("earlier")).where("n > 1"))
    return join_counted(once.select("hash", "row"), held, ["hash"], "n", "row").where("row <> earlier").select(F.col("row").alias("later"), "earlier").distinct()


def align_pairs(pairs: DataFrame, lines: DataFrame, min_words: int, partners: int) -> DataFrame:
    """(later, gone): the places to delete, from pairs and (row, lines).

    An earlier document's lines go once to every task that aligns some of its partners, ahead
    of them; partners stream past it, so a document paired with very many is no hot key.
    """
    counts = cut(pairs.groupBy("earlier").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / partners).cast("int")))
    dealt = join_counted(pairs, counts, ["earlier"], "n", "later").select("earlier", F.pmod(F.xxhash64("later"), F.col("salts")).cast("int").alias("salt"), "later")
    second = dealt.join(lines.select(F.col("row").alias("later"), "lines"), "later").select("earlier", "salt", "later", "lines")
    first = counts.join(lines.select(F.col("row").alias("earlier"), "lines"), "earlier").select("earlier", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("later"), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Earlier | None = None
        for batch in batches:
            later = batch.column(0).to_numpy()
            ends = batch.column(1).offsets.to_numpy().tolist()
            hashes, words = (batch.column(1).values.field(k).to_numpy().tolist() for k in (0, 1))
            rows: list[int] = []
            gone: list[list[int]] = []
            for row, a, b in zip(later.tolist(), ends, ends[1:], strict=False):
                if row < 0:
                    now = Earlier(hashes[a:b], words[a:b], min_words)
                elif now is not None and (found := now.aligned(hashes[a:b], words[a:b])):
                    rows.append(row)
                    gone.append(found)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["later", "gone"])

    together = first.unionByName(second).repartition("earlier", "salt").sortWithinPartitions("earlier", "salt", "later")
    return together.select("later", "lines").mapInArrow(run, "later long, gone array<int>")


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed"), partners: int = PARTNERS
) -> DataFrame:
    """The rows with common blocks deleted from later texts, and two counts of lines: all that are not blank, and removed.

    ``counts`` names these two columns; columns that already have the names are replaced.
    """
    docs = docs.drop(*counts)
    row, width, spot = fresh(docs, "row"), len(docs.columns), docs.columns.index(text)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    trimmed = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    lines = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.size(F.split(x, r"[\x20\x09-\x0D]+")).alias("words")))
    sketch = cut(numbered.select(F.col(row).alias("row"), rank.alias("rank"), lines.alias("lines")))
    pairs = cut(overlaps(sketch.select("row", "rank", block_hashes(F.col("lines"), min_words).alias("blocks"))))
    gone = align_pairs(pairs, sketch.select("row", "lines"), min_words, partners)
    gone = gone.select("later", F.explode("gone").alias("place")).groupBy("later").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    found = sketch.select("row", F.size("lines").cast("long").alias("all")).join(gone, F.col("row") == F.col("later"), "left")
    names = fresh(numbered, "lines_all"), fresh(numbered, "lines_gone")
    found = found.select(F.col("row").alias(row), F.col("all").alias(names[0]), F.col("gone").alias(names[1]))
    joined = numbered.join(found, row, "left").select(*docs.columns, *names)

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            gone = batch.column(width + 1).to_pylist()
            for t, places in zip(batch.column(spot).to_pylist(), gone, strict=True):
                if t is not None and places:
                    drop, k, kept = set(places), -1, []
                    for line in t.split("\n"):
                        k += bool(line.strip(WHITE))
                        if not (line.strip(WHITE) and k in drop):
                            kept.append(line)
                    t = "\n".join(kept)
                out.append(t)
            columns = list(batch.columns[:width])
            columns[spot] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, batch.column(width), pa.array([len(g or []) for g in gone], pa.int64())], names=[*batch.schema.names[:width], *counts])

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts)])
    return joined.mapInArrow(delete, schema)
