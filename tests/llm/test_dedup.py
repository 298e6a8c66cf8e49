"""Operators 1, 3, 5, 7 and 8 against brute force."""

import hashlib
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarn.llm import embedding_dedup, exact_dedup, line_dedup, simhash, suffix_dedup
from tarn.llm.common import components, forest

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def reach(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents, monkeypatch):
    base = [prose(60) for _ in range(12)]
    texts = [None, "", " \t", "One two\x0bthree", "ONE TWO THREE", "É É", "x " * 5000]
    for b in base:
        texts.append(b)
        for _ in range(6):
            w = b.split()
            w[R.randrange(len(w))] = R.choice(WORDS)
            texts.append(" ".join(w))
    texts += [base[0]] * 5
    fps = [fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = reach(range(len(fps)), links)
    assert len({want[i] for i in want}) < len(set(fps))  # near copies are there
    for hot in (64, 0):  # the second way compares all in blocks
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "CHUNK", 7)
        got = {x["key"]: x for x in simhash.near_duplicates(documents(texts)).collect()}
        for i, f in enumerate(fps):
            assert (got[i]["fingerprint"], got[i]["component_id"], got[i]["kept"]) == (f"{f:016x}", want[i], want[i] == i), texts[i]


def test_simhash_pairs_are_complete(spark):
    r = np.random.default_rng(3)
    centers = r.integers(-(2**63), 2**63 - 1, 40)
    fps = {0, *centers.tolist()}
    for c in centers.tolist():
        for _ in range(8):
            x = c
            for b in r.choice(64, r.integers(1, 6), replace=False).tolist():
                x ^= 1 << b if b < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    edges = simhash.link_edges(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert reach(fps, [(e["a"], e["b"]) for e in edges]) == reach(fps, links)


def test_thresholds_sum():
    n, both = 10**6, np.full((64, 64), 0.25) * 10**6
    np.fill_diagonal(both, 0.5 * 10**6)
    for size in (10, 10**4, 10**9):
        plan = simhash.allocate(size, both * (size / n))
        assert sum(t + 1 for _, t in plan) == 5 and sorted(b for bits, _ in plan for b in bits) == list(range(64))


def test_expected_candidates_know_correlations():
    """Groups of bits that copy each other: the estimate with pairs of bits is near the truth, one by single bits is far off."""
    r = np.random.default_rng(12)
    bits = np.repeat(r.random((4000, 16)) < 0.5, 4, axis=1) ^ (r.random((4000, 64)) < 0.03)
    both = bits.T.astype(float) @ bits
    group = simhash.group_bits(len(bits), both, 4)[0]
    assert all(len({b // 4 for b in g}) == 4 for g in simhash.group_bits(len(bits), both, 4))  # what goes together is together
    part = bits[:1500, group]
    differ = (part[:, None, :] != part[None, :, :]).sum(axis=2)[np.triu_indices(1500, 1)]
    alone = both.copy()
    p = np.diag(both) / len(bits)
    alone[~np.eye(64, dtype=bool)] = (np.outer(p, p) * len(bits))[~np.eye(64, dtype=bool)]
    for t in (1, 2):
        truth = (differ <= t).mean()
        estimate, by_single_bits = (simhash.within(len(bits), x, group, 4)[t] for x in (both, alone))
        assert truth / 3 < estimate < truth * 3 and by_single_bits < truth / 10, (t, truth, estimate, by_single_bits)


def test_ids_that_repeat_or_lack(spark, documents):
    docs = documents(["a b c d e", "a b c d e", None, "q"], [5, 5, None, None])
    got = sorted((str(x["key"]), str(x["component_id"]), x["kept"]) for x in simhash.near_duplicates(docs).collect())
    assert len(got) == 4 and [g for g in got if g[0] == "5"] == [("5", "5", False), ("5", "5", True)]
    exact = sorted((str(x["key"]), str(x["keep_key"]), x["group_size"], x["kept"]) for x in exact_dedup.exact_dedup(docs).collect())
    assert [g for g in exact if g[0] == "5"] == [("5", "5", 2, False), ("5", "5", 2, True)] and [g[2:] for g in exact if g[0] == "None"] == [(1, True)] * 2


def test_exact(documents):
    long = prose(4000)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\x0bb", "a b", long, long.replace(" ", "\n"), long + "x", long[:1024], long[:1024], long[:2048], long[:2048] + " ", *["c"] * 40]
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, size = {}, Counter(plain)
    for i, t in enumerate(plain):
        first.setdefault(t, i)
    got = {x["key"]: x for x in exact_dedup.exact_dedup(documents(texts)).collect()}
    for i, t in enumerate(plain):
        x = got[i]
        assert (x["keep_key"], x["group_size"], x["kept"], x["text_sha256"]) == (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest())


def test_blocks_whose_hashes_collide(spark):
    """A hash that is not that of one block alone names nothing: such blocks are compared by their text."""
    rows = [(0, ["a", "b"]), (1, ["a", "c"]), (2, ["b"]), (3, ["c"]), (4, ["d"]), (5, ["long"]), (6, ["long", "other"])]
    whole = spark.createDataFrame(rows, "row long, blocks array<string>").withColumn("hashes", F.transform("blocks", lambda x: F.length(x).cast("long")))
    got = {(x["row"], x["place"]): x["name"] for x in exact_dedup.named_blocks(whole, lambda x: F.length(x).cast("long")).collect()}
    text = {(r, i): x for r, b in rows for i, x in enumerate(b)}
    assert set(got) == {k for k, x in text.items() if x not in ("d", "other")}
    assert all((got[a] == got[b]) == (text[a] == text[b]) for a in got for b in got)


def test_exact_is_native(documents):
    plan = exact_dedup.exact_dedup(documents(["a", "a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def test_suffix(documents):
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("abé") for _ in range(n))
    shared = [letters(60) for _ in range(4)]
    texts = [None, "", "a" * 300, "ab" * 200, "a" * 39, "a" * 40, letters(100)]
    for _ in range(60):
        texts.append("".join(r.choice(shared)[r.randint(0, 20) : r.randint(30, 60)] if r.random() < 0.6 else letters(r.randint(0, 40)) for _ in range(r.randint(1, 6))))
    texts += texts[10:13]
    want = brute_repeats(texts, 40)
    for chunk in (10_000, 3):
        got = {x["key"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.remove_repeats(documents(texts), length=40, gram=8, chunk=chunk).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_intervals_and_anchors():
    assert sorted(suffix_dedup.intervals([0, 2, 2, 0, 3])) == sorted([(2, 0, 2), (3, 3, 4), (0, 0, 4)])
    r = random.Random(5)
    raw = bytes(r.choice(b"abcd") for _ in range(900))
    places = set(suffix_dedup.anchors(raw, 400, 128)[0].tolist())
    assert all(any(p in places for p in range(s, s + 273)) for s in range(len(raw) - 399))


def test_lines(documents):
    passage = "\n".join(prose(12) for _ in range(4))
    a, b = "\n".join(prose(9) for _ in range(5)), "\n".join(prose(9) for _ in range(5))
    short = "yes\nno"
    texts = [None, "", f"{a}\n{passage}\n\n{short}", f"{short}\n{passage}\n{b}", f"{b[:-3]}zz\n  {passage}  ", a, "\n\n", prose(9), "z" * 100_000]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(documents(texts)).collect()}
    assert [got[i]["text"] for i in (0, 1, 2, 6, 7, 8)] == [texts[i] for i in (0, 1, 2, 6, 7, 8)]
    assert got[3]["text"] == f"{short}\n{b}" and got[3]["n_removed"] == 4
    assert got[4]["text"] == b.split("\n")[-1][:-3] + "zz" and got[5]["text"] == "" and got[5]["n_removed"] == got[5]["n_lines"] == 5
    assert line_dedup.dedup_lines(documents([])).collect() == []


def kept_lines(texts, min_words=8):
    """What is left of each text by the definition alone: all blocks of a text against all earlier texts."""
    white = " \t\n\r\x0b\x0c"
    lines = [[x.strip(white) for x in (t or "").split("\n") if x.strip(white)] for t in texts]
    held, out = set(), []
    for t, own in zip(texts, lines, strict=True):
        blocks = {(i, j): tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if len(" ".join(own[i:j]).split()) >= min_words}
        gone = {k for (i, j), b in blocks.items() if b in held for k in range(i, j)}
        held |= set(blocks.values())
        k, kept = -1, []
        for x in (t or "").split("\n"):
            k += bool(x.strip(white))
            if not (x.strip(white) and k in gone):
                kept.append(x)
        out.append((None if t is None else "\n".join(kept), len(own), len(gone)))
    return out


def check_lines(documents, texts, **options):
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(documents(texts), **options).collect()}
    assert [got[i] for i in range(len(texts))] == kept_lines(texts)


def test_lines_against_brute_force(documents):
    """Few kinds of lines, so blocks repeat, move, overlap and have no unique line; and many holders of each."""
    r = random.Random(9)
    for kinds in (4, 12, 60):
        lines = ["".join(r.choice("ab ") for _ in range(3)) + "x " + " ".join(r.choice(WORDS) for _ in range(r.choice([1, 1, 2, 3, 4, 8, 9]))) for _ in range(kinds)]
        texts = [None, "", "\n"] + ["\n".join(r.choice([*lines, ""]) for _ in range(r.randint(0, 14))) for _ in range(60)]
        for partners in (2048, 3):
            check_lines(documents, texts, partners=partners)


def test_block_of_frequent_lines(documents):
    """Two documents share adjacent lines; each of the lines has ten earlier holders of its own."""
    lines = [prose(4) for _ in range(3)]
    texts = [f"{prose(9)}\n{x}\n{prose(9)}" for x in lines for _ in range(10)] + ["\n".join([prose(9), *lines, prose(9)]) for _ in range(2)]
    check_lines(documents, texts)
    got = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(documents(texts)).collect()}
    assert got[30] == 0 and got[31] == 3


def test_line_of_a_third_of_all_documents(documents, monkeypatch):
    from tarn.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)  # the key is broadcast, its rows are dealt out
    line = prose(20)
    check_lines(documents, [f"{prose(9)}\n{line}\n{prose(9)}" if k % 3 else prose(30) for k in range(60)], partners=5)


def test_line_dedup_keeps_other_columns(documents, clash):
    docs = documents(["a " * 9, "a " * 9]).drop("n_lines")
    for x in line_dedup.dedup_lines(docs, counts=("found", "removed")).collect():
        assert {k: x[k] for k in clash if k != "n_lines"} == {k: v for k, v in clash.items() if k != "n_lines"} and (x["found"], x["removed"]) == (1, x["doc_id"])


def test_patience():
    for _ in range(200):
        a, b = ([R.randint(0, 6) for _ in range(R.randint(0, 12))] for _ in range(2))
        m = line_dedup.align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
        assert bool(m) == bool(set(a) & set(b))
    assert line_dedup.align([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert line_dedup.align([5, 7, 7, 5, 1], [5, 7, 5, 7, 2]) == [(0, 0), (1, 1), (3, 2)]


def lines_in_blocks(later, earlier, words, min_words=8):
    """Lines of a later document in any run of enough words that the earlier one holds, by trying all runs."""
    gone = set()
    for i in range(len(later)):
        for j in range(i + 1, len(later) + 1):
            run = later[i:j]
            if sum(words[x] for x in run) >= min_words and any(earlier[k : k + j - i] == run for k in range(len(earlier))):
                gone.update(range(i, j))
    return sorted(gone)


def test_alignment_decides(documents, monkeypatch):
    """All that goes is aligned, and all that is shared is aligned in the end; no alignment, nothing goes."""
    words = [1, 2, 3, 5, 8, 9]
    for _ in range(500):
        a, b = ([R.randrange(len(words)) for _ in range(R.randint(0, 14))] for _ in range(2))
        earlier = line_dedup.Earlier(b, [words[x] for x in b], 8)
        assert earlier.aligned(a, [words[x] for x in a]) == lines_in_blocks(a, b, words)
    text = "\n".join(prose(9) for _ in range(4))
    assert {x["n_removed"] for x in line_dedup.dedup_lines(documents([text, text])).collect()} == {0, 4}
    monkeypatch.setattr(line_dedup, "align", lambda a, b: [])
    earlier = line_dedup.Earlier([1, 2], [9, 9], 8)
    assert earlier.aligned([1, 2], [9, 9]) == []


@pytest.mark.parametrize("order", ["turned", "shuffled", "repeated", "grid"])
def test_alignment_of_long_documents(order):
    """Rounds stay few whatever the order of the shared lines."""
    n = 10_000
    lines = list(range(n))
    later = {"turned": lines[::-1], "shuffled": random.Random(1).sample(lines, n), "repeated": [7] * n, "grid": [100 * (k % 100) + 99 - k // 100 for k in lines]}[order]
    start = time.monotonic()
    assert len(line_dedup.Earlier(lines, [9] * n, 8).aligned(later, [9] * n)) == n
    assert time.monotonic() - start < 60


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "k", 7) for i, v, l in rows], "vec_id long, embedding array<float>, label int, key string, item long")


def test_embeddings(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = []
    for c in range(30):
        center = r.normal(size=16)
        for _ in range(r.integers(1, 8)):
            rows.append(((center + r.normal(size=16) * r.choice([0, 0.05, 0.2])).tolist(), int(c % 3)))
    rows += [([0.0] * 16, 1), (None, 1), ([float("nan")] * 16, 1), ([1.0, None] * 8, 1), ([1.0] * 16, None), ([1.0] * 16, None), ([1.0, 0.0], 0), ([1.0, 0.01], 0), ([], 0)]
    rows += [(rows[0][0], rows[0][1])] * 20
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    links = {i: set() for i, _, _ in rows}
    ok = {i: np.array(v, np.float32).astype(float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for i, a in ok.items():
        for j, b in ok.items():
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                links[i].add(j)
    want = reach(links, [(i, j) for i in links for j in links[i]])
    monkeypatch.setattr(embedding_dedup, "CHUNK", 5)
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    for i in links:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), want[i], want[i] == i), i


def test_embedding_recall(spark):
    """Links at just the threshold, over a grid of many cells."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    y = 0.94 * x + np.sqrt(1 - 0.94**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    index = embedding_dedup.Index(x, 10**6, 0.93, 0.99)
    assert index.k > 8 and index.visits < index.k**2 / 2
    a, b = index.probes(list(x)), index.probes(list(y))
    found = (a == b[:, :1]).any(1)  # one side probes
    assert found.mean() >= 0.95
    ranks = embedding_dedup.nearer_cells(*index.gaps(x[:50]), b[:50, 0])
    for r in range(50):
        assert b[r, 0] in index.cells(x[r : r + 1], int(ranks[r]))[0] and (ranks[r] == 1 or b[r, 0] not in index.cells(x[r : r + 1], int(ranks[r]) - 1)[0])


def linked_vectors(seed, groups, dim=32):
    """Unit vectors in groups around a middle, with cosines on both sides of the linking one, over two labels."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = np.repeat(middle, 6, axis=0)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    near = r.uniform(0.955, 0.995, size=(len(x), 1))
    x = near * x + np.sqrt(1 - near**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return x, np.repeat(np.arange(groups) % 2, 6)


@pytest.mark.parametrize("cell,groups", [(256, 200), (32, 400), (8, 600)])
def test_measured_recall(spark, monkeypatch, cell, groups):
    """Links that the index finds among generated vectors, at grids of several sizes, against brute force; and none that isn't there."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    x, label = linked_vectors(groups, groups)
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    assert want.sum() > groups * 6 and (np.array([got[i] for i in range(len(x))]) <= want).all()
    assert sum(got.values()) >= 0.9 * want.sum()


def test_empty_vectors(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_traverse_is_a_full_sort():
    r = np.random.default_rng(6)
    one, two = r.random((20, 7)), r.random((20, 7))
    got = embedding_dedup.traverse(one, two, 12)
    sums = (one[:, :, None] + two[:, None, :]).reshape(20, -1)
    assert (got == np.argsort(sums, axis=1, kind="stable")[:, :12]).all()


def test_counted_join_deals_out_a_hot_key(spark, monkeypatch):
    """The same rows as a plain join; and the join is keyed by the salt too, so the hot key's rows are spread."""
    from tarn.llm import common

    monkeypatch.setattr(common, "HEAVY", 50)
    big = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 400).alias("k"))
    small = big.where("k < 300").groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("x"), "k"))
    joined = common.join_counted(big, small, ["k"], "n", "row")
    assert rows_of(joined) == rows_of(big.join(small, "k").select(*joined.columns))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in next(x for x in plan.splitlines() if "Join LeftOuter" in x and "salt" in x).split("=", 1)[1]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, x) for x in range(501, 560)]
    want = reach({x for e in edges for x in e}, edges)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got for n, c in want.items() if n != c)
    a, b = forest(np.array([3, 5, 9]), np.array([5, 7, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 3, 7: 3}


def test_queries_against_sql(spark):
    from compare import connect, rows

    from tarn.llm import queries

    sf = "/root/testdata/sf0.01"
    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(sql).fetchdf()), name


def test_empty_documents(documents):
    empty = documents([])
    assert simhash.near_duplicates(empty).collect() == [] and exact_dedup.exact_dedup(empty).collect() == [] and suffix_dedup.remove_repeats(empty).collect() == []
