"""Operator 11: language-model scores by prediction by partial matching (PPM).

A text is read as its lower-cased (A-Z) words, a blank after each, and an end symbol; bytes
are the symbols and 0xFF, which UTF-8 never uses, is the end.  The trie holds how often each
byte follows each context of up to ``order`` bytes, contexts run on across words, and a text
begins in the context of an end.  A byte's probability is that of the longest context that
training saw: with n occurrences and d kinds of followers there, a follower seen c times gets
(2c - 1) / 2n and the escape d / 2n (method D).  After an escape the next shorter context is
asked, without the symbols that the longer one would have given (symbol exclusion), and below
the empty context the bytes left over are equally likely.

Pretrained scores, as Spark jobs.  Texts lie in blocks of some ``BLOCK`` bytes.  A block is
reduced to its distinct n-grams and words with counts, so what is shuffled follows the kinds
in a block and not its length, and a gram or word meets its sums at most once a block: no key
is hot and nothing is broadcast or brought to the driver.  Sums over blocks give the trie's
leaves; shorter contexts are sums over suffixes.  The probability of a gram follows from that
of its suffix and two sums of its context, one join a level, for every gram that any text
holds.  Each block gets its own grams' logarithms back and adds them up per text.

Adaptive scores (``adaptive``) start from an empty trie in each text and learn as they read.

A null or empty text is the end alone.  Very long texts are read whole, in pieces that overlap
by a context.  Repeated rows give repeated results and are learned as often as they occur.
Rows with a null key are scored and not learned.  With nothing to learn from every byte has
probability 1/256.  Other columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import arrow_schema, cut_table, pieces

#: Bytes of context at most; with the byte that follows and a text's place in its piece they fit a long without its sign.
ORDER = 5
#: Bytes of text with one dictionary, places that are counted at once, and texts of a piece (15 bits).
BLOCK = 30_000_000
PIECE = 1 << 19
TEXTS = 1 << 14
END = 0xFF
#: The end of a text as a token; no word holds a blank.
END_TOKEN = b" "

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def symbols(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\xff"])


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """At each place from ``order`` on, the byte with its context as a number."""
    n = len(data) - order
    code = np.zeros(max(n, 0), np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= data[k : k + n]
    return code


def coded(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner) over pieces of about PIECE places; every text's places have its own contexts only."""
    pad = bytes([END]) * order
    joined, owners, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(joined), np.uint8)
        lengths = np.fromiter(map(len, joined), np.int64, len(joined))
        begin = np.cumsum(lengths) - lengths
        # The first bytes of a part are context only.
        inside = np.ones(len(data), bool)
        for k in range(order):
            inside[begin + k] = False
        return gram_codes(data, order)[inside[order:]], np.repeat(np.asarray(owners, np.int64), lengths - order)

    for i, t in enumerate(texts):
        whole = pad + t
        for a in range(0, len(t), PIECE):
            part = whole[a : a + PIECE + order]
            joined.append(part)
            owners.append(i)
            size += len(part)
            if size >= PIECE:
                yield flush()
                joined, owners, size = [], [], 0
    if joined:
        yield flush()


def runs_of(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return np.flatnonzero(first)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(codes)
    starts = runs_of(ordered)
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes with sums, of parts that are each sorted."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    starts = runs_of(code)
    return code[starts], np.add.reduceat(n, starts) if len(n) else n


def squeezed(texts: list[bytes]) -> bytes:
    return pa.compress(b"".join(texts), codec="zstd", asbytes=True)


def spread(body: bytes, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    flat = pa.decompress(body, decompressed_size=ends[-1], codec="zstd", asbytes=True)
    return [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def titled(rows: pa.Array, keys: pa.Array, sizes: list[int]) -> bytes:
    """What goes with a piece's texts, as bytes: rows of lists make Spark's Arrow writer slow."""
    batch = pa.RecordBatch.from_arrays([rows, keys, pa.array(sizes, pa.int64())], names=["row", "key", "size"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


BLOCKS = "block long, gram long, word binary, learned long, body binary"


def blocks(docs: DataFrame, order: int) -> DataFrame:
    """Rows of three kinds per block: its texts as compressed pieces of symbols, its grams and its words with the times they are learned."""
    schema = arrow_schema(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: Counter[bytes] = Counter()
        others: set[bytes] = set()

        def rows(n: int, **given: pa.Array) -> pa.RecordBatch:
            given["block"] = pa.array(np.full(n, block))
            return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            code, learned = merged(grams)
            for a in range(0, len(code), 1 << 18):
                part = code[a : a + (1 << 18)]
                yield rows(len(part), gram=pa.array(part), learned=pa.array(learned[a : a + (1 << 18)]))
            found = [*tokens, *(others - tokens.keys())]
            for a in range(0, len(found), 1 << 16):
                part = found[a : a + (1 << 16)]
                yield rows(len(part), word=pa.array(part, pa.binary()), learned=pa.array([tokens[w] for w in part], pa.int64()))
            grams.clear(), tokens.clear(), others.clear()

        for batch, texts in pieces(batches, "text"):
            learn = np.asarray(batch.column(batch.schema.get_field_index("learn")).to_pylist(), bool)
            for at in range(0, len(texts), TEXTS):
                yes = learn[at : at + TEXTS]
                split = [words_of(t) for t in texts[at : at + TEXTS]]
                made = [symbols(w) for w in split]
                for code, owner in coded(made, order):
                    mine = yes[owner]
                    for part, times in ((code[mine], 1), (code[~mine], 0)):
                        if len(part):
                            kinds, n = counted(part)
                            grams.append((kinds, n * times))
                    if len(grams) > 1 and sum(len(g[0]) for g in grams[1:]) > max(2 * PIECE, len(grams[0][0])):
                        grams[:] = [merged(grams)]
                for w, y in zip(split, yes.tolist(), strict=True):
                    (tokens if y else others).update(w)
                others.add(END_TOKEN)
                tokens[END_TOKEN] += int(yes.sum())
                head = titled(batch.column(0).slice(at, TEXTS), batch.column(1).slice(at, TEXTS), [len(t) for t in made])
                yield rows(1, body=pa.array([len(head).to_bytes(8, "little") + head + squeezed(made)], pa.binary()))
                size += sum(map(len, made))
                if size >= BLOCK:
                    yield from close()
                    block, size = block + 1, 0
        if grams:
            yield from close()

    return docs.select("row", "key", "text", "learn").mapInArrow(run, BLOCKS)


def gram_logs(counts: DataFrame, order: int) -> DataFrame:
    """(gram, logp): for every gram of ``counts`` (gram, c), learned or not, the log10 probability of its last byte.

    Of a gram at each level: c, how often it was learned; p, the logarithm if its context is
    the longest that is asked; e, the logarithm after an escape from its context.  Of its
    context: n and d, and m and k, the occurrences and kinds that the next shorter context
    has left once the followers of this one are excluded.
    """
    levels = {order: cut_table(counts)}
    for k in range(order - 1, -1, -1):
        shorter = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("gram")).agg(F.sum("c").alias("c"))
        levels[k] = cut_table(shorter)
    log = lambda a, b: F.log10(F.try_divide(a.cast("double"), b))
    # A context has 256 followers at most, so no window is large.
    followers = Window.partitionBy("context")
    within = lambda c: c.over(followers)
    below = None
    for k in range(order + 1):
        level = levels[k].withColumn("context", F.shiftrightunsigned("gram", 8))
        if below is None:
            level = level.select("*", F.lit(0).alias("c1"), F.lit(0).alias("n1"), F.lit(256).alias("d1"), F.lit(0.0).alias("e1"), F.lit(-math.log10(256)).alias("p1"))
        else:
            level = level.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(below, "low")
        level = level.select("*", within(F.sum("c")).alias("n"), within(F.count_if(F.col("c") > 0)).alias("d"), within(F.sum(F.when(F.col("c") > 0, F.col("c1")).otherwise(0))).alias("given"))
        level = level.withColumn("m", F.col("n1") - F.col("given")).withColumn("k", F.col("d1") - F.col("d"))
        if k == 0:
            escaped = -F.log10(F.col("k").cast("double"))
        else:
            further = F.when(F.col("k") > 0, log(F.col("k"), 2 * F.col("m"))).otherwise(0.0) + F.col("e1")
            escaped = F.when(F.col("c1") > 0, log(2 * F.col("c1") - 1, 2 * F.col("m"))).otherwise(further)
        own = F.when(F.col("c") > 0, log(2 * F.col("c") - 1, 2 * F.col("n"))).when(F.col("n") > 0, log(F.col("d"), 2 * F.col("n")) + F.col("e")).otherwise(F.col("p1"))
        level = level.withColumn("e", F.when(F.col("c") == 0, escaped)).withColumn("p", own)
        below = level.select(F.col("gram").alias("low"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("d").alias("d1"), F.coalesce("e", F.lit(0.0)).alias("e1"), F.col("p").alias("p1"))
        below = cut_table(below) if k < order else below
    return below.select(F.col("low").alias("gram"), F.col("p1").alias("logp"))


def _add_scores(rows: DataFrame, kind: str, order: int, norm: float) -> DataFrame:
    """Sums per text from (spot, number, body, value) with spot = 4 block + stage; of each block the grams come first, then the words, then the texts."""
    ddl = f"row long, key {kind}, n_tokens long, n_known long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        place: dict[bytes, int] = {}
        rates: list[np.ndarray] = []
        known = logp = rate = seen = np.zeros(0)
        for batch in batches:
            spot = batch.column(0).to_numpy()
            cuts = np.flatnonzero(spot[1:] != spot[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(spot)], strict=True):
                if a == b:
                    continue
                if spot[a] >> 2 != block:
                    block, grams, place, rates = spot[a] >> 2, [], {}, []
                part = batch.slice(a, b - a)
                if spot[a] & 3 == 0:
                    grams.append((part.column(1).to_numpy(), part.column(3).to_numpy()))
                elif spot[a] & 3 == 1:
                    place.update(zip(part.column(2).to_pylist(), range(len(place), len(place) + part.num_rows), strict=True))
                    c = part.column(1).to_numpy()
                    rates.append(np.stack([np.log10((c + 1) / norm), c > 0]))
                else:
                    if grams:
                        code, value = (np.concatenate(x) for x in zip(*grams, strict=True))
                        at = np.argsort(code)
                        known, logp, grams = code[at], value[at], []
                        (rate, seen), rates = np.concatenate(rates, axis=1), []
                    for body in part.column(2).to_pylist():
                        ends = 8 + int.from_bytes(body[:8], "little")
                        titles = pa.ipc.open_stream(body[8:ends]).read_next_batch()
                        sums = scored(spread(body[ends:], titles.column(2).to_pylist()), known, logp, place, rate, seen)
                        yield pa.RecordBatch.from_arrays([titles.column(0), titles.column(1).cast(schema.field("key").type), *map(pa.array, sums)], schema=schema)

    def scored(texts: list[bytes], known: np.ndarray, logp: np.ndarray, place: dict[bytes, int], rate: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        total = np.zeros(len(texts))
        for code, owner in coded(texts, order):
            packed = np.sort((code << 15) | owner)
            code = packed >> 15
            starts = runs_of(code)
            value = np.repeat(logp[np.searchsorted(known, code[starts])], np.diff(np.append(starts, len(code))))
            total += np.bincount(packed & 0x7FFF, weights=value, minlength=len(texts))
        split = [[*t[:-1].split(), END_TOKEN] for t in texts]
        each = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(each.sum()))
        owner = np.repeat(np.arange(len(texts)), each)
        add = lambda weights: np.bincount(owner, weights=weights[ids], minlength=len(texts))
        return [each, add(seen).astype(np.int64), add(rate), total]

    return rows.repartition(F.shiftright("spot", 2)).sortWithinPartitions("spot").mapInArrow(run, ddl)


def score(docs: DataFrame, learned: F.Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(row, key, n_tokens, n_known, train_tokens, base_score, score) of every row.

    learned is a predicate on the column ``key``: from which rows counts are taken.
    base_score is the log10 probability under add-one counts of whole words, score the one
    under the trie; both are of the same words and end.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), docs[text].alias("text")).withColumn("learn", F.coalesce(learned, F.lit(False)))
    kind = source.schema["key"].dataType.simpleString()
    held = cut_table(blocks(source, order))
    grams = held.where("gram is not null").select("block", "gram", "learned")
    logs = gram_logs(grams.groupBy("gram").agg(F.sum("learned").alias("c")), order)
    # A word has a row a block at most, so its rows meet in a window and are shuffled once.
    same = Window.partitionBy("word")
    words = held.where("word is not null").select("block", "word", F.sum("learned").over(same).alias("c"), (F.col("block") == F.min("block").over(same)).alias("once"))
    words = cut_table(words)
    n, v = words.where("once").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first() or (0, 0)
    none = lambda kind: F.lit(None).cast(kind)
    spot = lambda stage: (F.col("block") * 4 + stage).alias("spot")
    # A float holds a logarithm to seven digits and halves what is shuffled for it.
    found_grams = grams.join(logs, "gram").select(spot(0), F.col("gram").alias("number"), none("binary").alias("body"), F.col("logp").cast("float").alias("value"))
    found_words = words.select(spot(1), F.col("c").alias("number"), F.col("word").alias("body"), none("float").alias("value"))
    texts = held.where("body is not null").select(spot(2), none("long").alias("number"), "body", none("float").alias("value"))
    found = _add_scores(found_grams.union(found_words).union(texts), kind, order, float(n + v + 1))
    return found.select("row", "key", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def code_length(data: bytes, order: int = ORDER) -> float:
    """log10 probability of the symbols under a trie that starts empty and learns each symbol once it is coded."""
    trie: dict[bytes, dict[int, int]] = {}
    total = 0.0
    before = bytes([END]) * order
    for b in data:
        out: set[int] = set()
        for k in range(order, -1, -1):
            seen = trie.get(before[order - k :])
            left = {s: c for s, c in seen.items() if s not in out} if seen else {}
            if not left:
                continue
            n = sum(left.values())
            if b in left:
                total += math.log10((2 * left[b] - 1) / (2 * n))
                break
            total += math.log10(len(left) / (2 * n))
            out |= left.keys()
        else:
            total -= math.log10(256 - len(out))
        for k in range(order + 1):
            at = trie.setdefault(before[order - k :], {})
            at[b] = at.get(b, 0) + 1
        before = (before + bytes([b]))[1:]
    return total


def adaptive(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, score) of every row, each text scored by what its own beginning teaches."""
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = [code_length(symbols(words_of(t)), order) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "score"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, score double")
