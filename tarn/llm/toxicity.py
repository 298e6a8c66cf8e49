"""Operator 9: toxicity by class-conditional Kneser-Ney models.

Two models of the bytes within words, one of toxic and one of ordinary labelled texts, are
counted over all labelled training rows.  They share their backoff: the orders below the
highest are interpolated Kneser-Ney with continuation counts from both classes, and the
weight given to them after a context comes from both classes' counts too.  What follows a
context in one class is smoothed by what follows it in both, with the weight of ``PRIOR``
observations, so a rare expression says little on its own:

    p_c(b | h) = (1 - w_h) (n_c(h b) + PRIOR q(b | h)) / (n_c(h) + PRIOR) + w_h p(b | h')

with w_h = discount x kinds(h) / n(h), q the discounted distribution of both classes after h
and h' the context without its first byte.  After a context that training never saw, or for a
byte never seen after it, both classes give the same backed-off probability, so the ratio of
the two is 1 to the last digit; the table holds the log ratio of every n-gram that training saw.

A text's two features are normalised by its length: the mean log ratio over its n-grams, and
the share of its words whose toxic log-likelihood is more than ``VOTE`` above the ordinary
one.  A logistic function, fitted on at most ``fit_rows`` labelled training rows, maps them to
a score from 0 to 1.

The table grows with the corpus.  Up to ``table_rows`` n-grams it is broadcast; a longer one
stays distributed: each word kind of the texts gets its log ratio by a join on its n-grams,
and each text by a join on its words.  The scores are the same either way.

A null or empty text has no words and gets the score of features 0.  A very long text is read
whole; of a run of bytes without white space every ``WORD_BYTES`` are a word.  Repeated rows
give repeated results, null keys stay null and never carry a label, labels that are null are
left out, other columns are ignored, an empty table gives no rows.  With no labelled rows, or
one class only, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, join_counted, pieces

#: Bytes of the highest order's n-grams; seven or fewer fit a long without its sign.
ORDER = 6
DISCOUNT = 0.75
#: Observations that both classes together count for after a context of one class.
PRIOR = 4.0
#: A word is an expression of toxicity beyond this log ratio.
VOTE = 3.0
#: A longer table of log ratios is not broadcast.
TABLE_ROWS = 1 << 21
FIT_ROWS = 20_000
#: Of a word's bytes, so many at most enter a model; the rest of a longer run is read as further words.
WORD_BYTES = 48
FEATURES = ["mean", "share"]


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words, padded with blanks in front and one behind, as numbers; and how many each word has."""
    pad = b" " * (order - 1)
    flat = np.frombuffer(b"".join([pad + w + b" " for w in words]) or b" ", np.uint8).astype(np.int64)
    n = len(flat) - order + 1
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    if n <= 0 or not words:
        return np.zeros(0, np.int64), size
    code = np.zeros(n, np.int64)
    for k in range(order):
        code = (code << 8) | flat[k : k + n]
    begin = np.cumsum(size + order - 1) - (size + order - 1)
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return code[at], size


def text_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    out: list[bytes] = []
    each = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.lower().encode().split()
        if len(t) > WORD_BYTES and any(len(w) > WORD_BYTES for w in found):
            found = [w[k : k + WORD_BYTES] for w in found for k in range(0, len(w), WORD_BYTES)]
        out += found
        each[i] = len(found)
    return out, each


def distinct(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    return list(index), at


def count_grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary) counts over rows (text, label); summed in the batch, then by shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            labels = np.asarray(batch.column(1).to_pylist(), np.int64)
            words, each = text_words(texts)
            kinds, at = distinct(words)
            toxic = np.bincount(at, weights=np.repeat(labels, each), minlength=len(kinds))
            total = np.bincount(at, minlength=len(kinds))
            code, size = grams(kinds, order)
            if not len(code):
                continue
            unique, back = np.unique(code, return_inverse=True)
            a = np.bincount(back, weights=np.repeat(toxic, size)).astype(np.int64)
            b = np.bincount(back, weights=np.repeat(total, size)).astype(np.int64) - a
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(a), pa.array(b)], names=["gram", "toxic", "ordinary"])

    counted = labelled.select("text", "label").mapInArrow(run, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_orders(counts: DataFrame, order: int, discount: float) -> DataFrame:
    """(low, p): the shared Kneser-Ney probability of every n-gram of the second highest order.

    Continuation counts of an order are the distinct n-grams one longer that end in it; each
    order interpolates with the one below, the lowest with the even distribution over bytes.
    """
    mask = lambda k: (1 << (8 * k)) - 1
    levels = {order: counts.select("gram").distinct()}
    continued = {}
    for k in range(order - 1, 0, -1):
        continued[k] = levels[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = continued[k].select("gram")
    below = None
    for k in range(1, order):
        level = continued[k].withColumn("context", F.shiftrightunsigned("gram", 8))
        totals = level.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("types"))
        joined = level.join(totals, "context")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            joined = joined.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(below, "low")
            lower = F.col("p")
        own = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("n") + discount * F.col("types") / F.col("n") * lower
        below = joined.select(F.col("gram").alias("low"), own.alias("p"))
    return below


def ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT, prior: float = PRIOR) -> DataFrame:
    """(gram, toxic, ordinary, ratio): the last byte's probability after the others in both classes, and the log of their ratio."""
    mask = (1 << (8 * (order - 1))) - 1
    level = counts.withColumn("context", F.shiftrightunsigned("gram", 8)).withColumn("low", F.col("gram").bitwiseAND(F.lit(mask)))
    totals = level.groupBy("context").agg(F.sum("toxic").alias("toxic_n"), F.sum("ordinary").alias("ordinary_n"), F.count("*").alias("kinds"))
    joined = level.join(totals, "context").join(shared_orders(counts, order, discount), "low")
    n = F.col("toxic_n") + F.col("ordinary_n")
    weight = discount * F.col("kinds") / n
    both = (F.col("toxic") + F.col("ordinary") - discount) / n

    def p(c: str) -> F.Column:
        return ((1 - weight) * F.col(c) + prior * both) / (F.col(f"{c}_n") + prior) + weight * F.col("p")

    return joined.select("gram", p("toxic").alias("toxic"), p("ordinary").alias("ordinary")).withColumn("ratio", F.log(F.col("toxic") / F.col("ordinary")))


def word_ratios(kinds: list[bytes], gram: np.ndarray, ratio: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of each word, and its number of n-grams; ``gram`` is sorted."""
    code, size = grams(kinds, order)
    if not len(code):
        return np.zeros(len(kinds)), size
    at = np.minimum(np.searchsorted(gram, code), len(gram) - 1)
    return np.add.reduceat(np.where(gram[at] == code, ratio[at], 0.0), np.cumsum(size) - size), size


def text_sums(owner: np.ndarray, n: int, by_word: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Per text: the sum of its words' log ratios, their n-grams, the words beyond VOTE, the words."""
    add = lambda values: np.bincount(owner, weights=values, minlength=n).astype(float)
    return [add(by_word), add(size), add(by_word > VOTE), add(np.ones(len(owner)))]


SUMS = ["ratio", "grams", "votes", "words"]


def normalised(sums: DataFrame) -> DataFrame:
    """The two features of each row from its sums; 0 where there are no words."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("row", "key", share("ratio", "grams").alias("mean"), share("votes", "words").alias("share"))


def features(docs: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(row, key, features) from (row, key, text) with the whole table broadcast; a map without shuffle."""
    rows = table.select("gram", "ratio").orderBy("gram").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("gram").to_numpy(), rows.column("ratio").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            words, each = text_words(texts)
            kinds, at = distinct(words)
            by_word, size = word_ratios(kinds, *shared.value, order)
            owner = np.repeat(np.arange(len(texts)), each)
            sums = text_sums(owner, len(texts), by_word[at], size[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, sums)], names=["row", "key", *SUMS])

    kind = docs.schema["key"].dataType.simpleString()
    return normalised(docs.select("row", "key", "text").mapInArrow(run, f"row long, key {kind}, " + ", ".join(f"{f} double" for f in SUMS)))


def features_by_joins(docs: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """The same with the table left distributed: n-grams of word kinds meet the table, words of texts meet their kinds."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            rows = batch.column(0).to_numpy()
            words, each = text_words(texts)
            kinds, at = distinct(words)
            code = np.repeat(np.arange(len(texts)), each) * max(len(kinds), 1) + at
            pair, count = np.unique(code, return_counts=True)
            text, kind = np.divmod(pair, max(len(kinds), 1))
            yield pa.RecordBatch.from_arrays([pa.array(rows[text]), pa.array(kinds, pa.binary()).take(pa.array(kind)), pa.array(count)], names=["row", "word", "times"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, size = grams(batch.column(0).to_pylist(), order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(code)], names=["word", "gram"])

    spelled = cut(docs.select("row", "text").mapInArrow(spell, "row long, word binary, times long"))
    kinds = spelled.groupBy("word").agg(F.count("*").alias("n"))
    parts = cut(kinds.select("word").mapInArrow(split, "word binary, gram long"))
    wanted = cut(parts.groupBy("gram").agg(F.count("*").alias("n")).join(table.select("gram", "ratio"), "gram"))
    by_word = join_counted(parts, wanted, ["gram"], "n", "word").groupBy("word").agg(F.sum("ratio").alias("ratio"))
    known = cut(kinds.join(by_word, "word", "left").select("word", "n", F.coalesce("ratio", F.lit(0.0)).alias("ratio")))
    own = lambda c: F.sum(c * F.col("times")).cast("double")
    sums = join_counted(spelled, known, ["word"], "n", "row").groupBy("row").agg(
        own(F.col("ratio")).alias("ratio"), own(F.length("word") + 1).alias("grams"), own((F.col("ratio") > VOTE).cast("int")).alias("votes"), own(F.lit(1)).alias("words")
    )
    return normalised(docs.select("row", "key").join(sums, "row", "left"))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def score(docs: DataFrame, labels: DataFrame, counted: F.Column, fitted: F.Column, key: str = "doc_id", text: str = "text", threshold: float = 0.3, fit_rows: int = FIT_ROWS, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(row, key, score, predicted) of every row.

    labels: (key, label); several labels of a key count as toxic if any is.  counted and
    fitted are predicates on the column ``key``: whose labels the two models count, and whose
    labels the logistic function is fitted to.  Keep them apart, else the fit sees models that
    know its rows.  Labels of other rows are never looked at.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    known = labels.select(F.col(labels.columns[0]).alias("label_key"), F.col(labels.columns[1]).cast("long").alias("label")).where("label_key is not null and label is not null")
    known = known.groupBy("label_key").agg(F.max("label").alias("label"))
    # Labels grow with the documents, so they are never broadcast: the join is the same at every size.
    known = known.hint("merge")
    training = source.where(counted).join(known, F.col("key") == F.col("label_key")).select("text", "label")
    counts = cut(count_grams(training))
    seen = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not seen[0] or not seen[1]:
        return source.select("row", "key", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = cut(ratios(counts))
    found = cut((features if model.count() <= table_rows else features_by_joins)(source, model))
    sample = found.where(fitted).join(known, F.col("key") == F.col("label_key")).orderBy(F.xxhash64(F.col("key").cast("string")), "row").limit(fit_rows).select(*FEATURES, "label").toPandas()
    if sample["label"].nunique() < 2:
        return source.select("row", "key", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    w, offset = fit(sample[FEATURES].to_numpy(), sample["label"].to_numpy(float))
    logit = reduce(lambda a, b: a + b, (F.col(f) * float(c) for f, c in zip(FEATURES, w, strict=True)), F.lit(offset))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return found.select("row", "key", p.alias("score"), F.when(p >= threshold, 1).otherwise(0).alias("predicted"))
