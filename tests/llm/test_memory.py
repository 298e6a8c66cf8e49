"""What the operators hold in Python workers at once."""

import tracemalloc

import pyarrow as pa

from tarn import session
from tarn.llm import packing
from tarn.llm.common import components, pieces
from tarn.llm.queries import byte_bpe


def test_texts_of_one_piece_at_once():
    """Of a batch of 24 MB only some 2 MB are Python strings at a time; texts and their order stay."""
    texts = [None if i % 7 == 0 else f"{i:06d}" * 1000 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["key", "text"])
    tracemalloc.start()
    rows = 0
    for part, held in pieces(iter([batch])):
        assert held == [t or "" for t in texts[rows : rows + part.num_rows]] and part.column(0)[0].as_py() == rows
        rows += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 12_000_000
    empty = batch.slice(0, 0)
    assert not list(pieces(iter([empty]))) and [p.num_rows for p, _ in pieces(iter([batch.slice(0, 1)]))] == [1]


def test_batches_are_bounded_by_bytes(spark):
    name, bound = session.BATCH_BYTES
    before = spark.conf.get(name, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    rows = spark.range(0, 6000, 1, 1).selectExpr("repeat(concat(id, ' '), 1000) as text")
    try:
        spark.conf.unset(name)
        session.ship(spark)
        assert spark.conf.get(name) == bound
        found = rows.mapInArrow(sizes, "size long, n long").collect()
        assert sum(x["n"] for x in found) == 6000 and max(x["size"] for x in found) < 10_000_000
        spark.conf.set(name, "1m")  # a bound that the session names stays
        session.ship(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def test_known_words_are_bounded():
    e = packing.Encoder(byte_bpe())
    for k in range(30):
        e.ids([" ".join(str(k * 20_000 + i) for i in range(20_000))])
    assert len(e.known) < 300_000


def test_components_take_forests_as_they_are(spark):
    edges, forests = [(5, 6), (9, 8), (3, 3)], [(6, 2), (8, 20), (31, 30), (7, 7)]
    frames = [spark.createDataFrame(x, "a long, b long") for x in (edges, forests)]
    got = {x["node"]: x["component"] for x in components(frames[0], forests=frames[1]).collect()}
    assert {k: v for k, v in got.items() if k != v} == {5: 2, 6: 2, 9: 8, 20: 8, 31: 30}
