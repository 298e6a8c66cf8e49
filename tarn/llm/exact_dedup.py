"""Operator 5: exact dedup by deterministic block naming, with DataFrame functions only.

White-space runs become one space; texts are cut into blocks of fixed size.  Equal blocks get
one integer name: those that occur more than once are sorted within buckets of their hash and
numbered, so a name depends on the content alone and no two blocks share one; the buckets are
so many that each sorts about ``BUCKET`` blocks.  Adjacent names of a text are paired and the
pairs named in the same way, until every text is one name.  A text that holds a block or pair
no other place holds differs from all others and leaves at once, so later rounds see only
what is still shared.

Blocks are counted by a partial aggregation before the shuffle, the only one that carries their
text.  Names are joined back by the blocks' 64-bit hashes where a hash is that of one block
alone, which is known if the block counts as often as its hash; other blocks are joined by
their text.  The join deals the places of a frequent block over all tasks, so one block in a
third of all places is never gathered in one.

A null text counts as empty; all empty texts are equal.  A very long text is more blocks and
more rounds.  Rows with the same or a null key are rows of their own: each is named by its
place in the scan, which must be deterministic.  An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, cut_table, join_counted

BLOCK = 1024
#: Repeated blocks that are sorted and numbered together, on average.
BUCKET = 16_384
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def names(values: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n, name) of the values that occur more than once, n times."""
    repeated = cut(values.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1"))
    buckets = repeated.count() // BUCKET + 1
    order = Window.partitionBy("bucket").orderBy(*columns)
    numbered = repeated.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    return cut(numbered.select(*columns, "n", (F.row_number().over(order).cast("long") * buckets + F.col("bucket")).alias("name")))


def shared(found: DataFrame, size: DataFrame) -> DataFrame:
    """The named rows of the texts all of whose values have a name; size: (row, all)."""
    whole = found.groupBy("row").agg(F.count("*").alias("k")).join(size, "row").where(F.col("k") == F.col("all")).select("row")
    return found.join(whole, "row", "left_semi")


def named_blocks(whole: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(row, place, name) of the blocks that occur more than once, from (row, blocks, hashes)."""
    places = whole.select("row", F.posexplode("hashes").alias("place", "hash"))
    named = names(whole.select(F.explode("blocks").alias("block")), ["block"]).withColumn("hash", hashed(F.col("block")))
    often = cut(places.groupBy("hash").agg(F.count("*").alias("all")).where("all > 1"))
    met = cut(named.join(often, "hash").select("hash", "n", "all", "name"))
    found = join_counted(places, met.where("n = all").select("hash", "n", "name"), ["hash"], "n", "row").select("row", "place", "name")
    doubtful = met.where("n < all").select("hash", "name")
    if doubtful.isEmpty():
        return found
    texts = named.join(doubtful, ["hash", "name"], "left_semi").select("block", "n", "name")
    return found.unionByName(join_counted(whole.select("row", F.posexplode("blocks").alias("place", "block")), texts, ["block"], "n", "row").select("row", "place", "name"))


def identities(whole: DataFrame) -> DataFrame:
    """(row, rounds, name) of the texts that are not the only one of their kind.

    whole: (row, blocks, hashes), the blocks of each text and their hashes.
    """
    size = whole.select("row", F.size("hashes").alias("all"))
    found = cut(named_blocks(whole, F.xxhash64))
    now = cut(shared(found, size))
    done = None
    rounds = 0
    while True:
        size = now.groupBy("row").agg(F.count("*").alias("all"))
        ended = now.join(size.where("all = 1").select("row"), "row", "left_semi").select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        now = now.join(size.where("all > 1").select("row"), "row", "left_semi")
        pairs = now.groupBy("row", F.expr("cast(place div 2 as int)").alias("at")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = cut(pairs)
        if pairs.isEmpty():
            return done
        found = join_counted(pairs, names(pairs.select("left", "right"), ["left", "right"]), ["left", "right"], "n", "row").select("row", F.col("at").alias("place"), "name")
        now = cut(shared(cut(found), pairs.groupBy("row").agg(F.count("*").alias("all"))))
        rounds += 1


def exact_dedup(docs: DataFrame, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, keep_key, group_size, kept, text_sha256) of every row.

    Of equal texts the row with the smallest key stays (null keys come last; of equal keys the
    first row in the scan).
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), normalised(docs[text]).alias("text"))
    pieces = F.when(F.length("text") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).otherwise(F.array(F.lit("")))
    # Normalised once: every later step reads this table.
    cut_up = source.select("row", "key", F.sha2("text", 256).alias("text_sha256"), pieces.alias("blocks"))
    whole = cut_table(cut_up.withColumn("hashes", F.transform("blocks", lambda x: F.xxhash64(x))))
    keyed = whole.select("row", "key", "text_sha256")
    classes = identities(whole.select("row", "blocks", "hashes"))
    members = cut(keyed.select("row", "key").join(classes, "row"))
    groups = cut(
        members.groupBy("rounds", "name").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"), F.count("*").alias("group_size"))
    )
    found = join_counted(members, groups, ["rounds", "name"], "group_size", "row").select("row", F.col("first.key").alias("keep_key"), F.col("first.row").alias("keep_row"), "group_size")
    return keyed.join(found, "row", "left").select(
        "row",
        "key",
        F.when(F.col("keep_row").isNull(), F.col("key")).otherwise(F.col("keep_key")).alias("keep_key"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )
